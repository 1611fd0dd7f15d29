"""Table schemas as DDL text. Times are UTC; a point is two nullable doubles."""

from __future__ import annotations

INCIDENTS = (
    "id bigint, title string, title_ne string, hazard_id int, incident_on timestamp, "
    "reported_on timestamp, verified boolean, approved boolean, source string, data_source string, "
    "lon double, lat double, loss_id int, created_on timestamp, modified_on timestamp, raw_data string"
)
HAZARDS = ("id int, title string, title_ne string, type string, color string, icon_url string")
DISTRICTS = ("id int, title string, title_ne string, code string, province_id int")
MUNICIPALITIES = ("id int, title string, title_ne string, type string, code string, district_id int")
INCIDENT_RAIN = (
    "incident_id bigint, incident_date date, rain_1d double, rain_3d double, rain_7d double, "
    "rain_peak_7d double, fetched_at timestamp"
)
DISTRICT_DAILY_RAIN = (
    "district_id int, sample_date date, rain_1d decimal(10,4), rain_3d decimal(10,4), "
    "rain_7d decimal(10,4), rain_peak_7d decimal(10,4), ingested_at timestamp"
)
RAIN_GRID = ("cell_x int, cell_y int, date date, precip_mm double")
PANEL = (
    "district string, hazard string, year int, month int, incident_count bigint, "
    "prev_month_count bigint, historical_month_avg double"
)
ANOMALIES = (
    "district string, hazard string, year int, month int, incident_count bigint, "
    "predicted double, residual double, surprise_ratio double"
)
RUN_LOG = ("run_id string, name string, kind string, key string, value string, start_time timestamp")

# One landed report. `hazard`, `loss` and `point` stay raw JSON text, so that bad ones can be told from absent ones.
REPORT = (
    "id string, title string, titleNe string, hazard string, incidentOn string, reportedOn string, "
    "verified string, approved string, source string, dataSource string, "
    "point string, loss string, createdOn string, modifiedOn string"
)
PAGE = ("results array<string>, next string, _broken string")

# Columns of the incident list, and of the hazard nested in it.
LIST_FIELDS = ["id", "title", "title_ne", "hazard_id", "incident_on", "reported_on", "verified", "approved", "lat", "lon"]
HAZARD_FIELDS = ["id", "title", "title_ne", "type", "color"]

# Write rules per table: identity, columns kept from first sight, columns the newest row overwrites.
UPSERT_RULES = {
    "incidents": (["id"], ["title", "verified", "approved", "modified_on", "raw_data"]),
    "hazards": (["id"], ["title", "type"]),
    "districts": (["id"], ["title"]),
    "municipalities": (["id"], ["title"]),
    "incident_rain": (["incident_id"], ["rain_1d", "rain_3d", "rain_7d", "fetched_at"]),
    "district_daily_rain": (
        ["district_id", "sample_date"],
        ["rain_1d", "rain_3d", "rain_7d", "rain_peak_7d", "ingested_at"],
    ),
}
