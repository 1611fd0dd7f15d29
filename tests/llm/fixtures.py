"""Small documents with every awkward case, and plain-Python answers to compare with."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, hash string, kept string"

ENGLISH = "the house by the river was sold and the people that lived there went with their things to another town"
FRENCH = "la maison pres de la riviere est vendue et les gens qui y vivaient sont partis avec leurs affaires dans une autre ville"
GERMAN = "das haus an dem fluss wurde verkauft und die leute die dort wohnten gingen mit ihren sachen in eine andere stadt"


def words(seed: int, n: int, base: str) -> str:
    """n words of the base text in a repeatable jumble."""
    pool = base.split()
    return " ".join(pool[zlib.crc32(f"{seed}:{i}".encode()) % len(pool)] for i in range(n))


def documents() -> list[tuple]:
    rows = []
    for i in range(60):
        lang, base = (("en", ENGLISH), ("fr", FRENCH), ("de", GERMAN))[i % 3]
        rows.append((i, words(i, 30 + 7 * (i % 9), base).capitalize() + ".", lang, f"s{i % 4}"))
    copied = rows[4][1]
    rows += [(100 + i, copied, "fr", "s0") for i in range(20)]  # many copies
    rows += [(130, copied.replace(" ", "\n\t"), "fr", None), (131, "  " + copied + " ", None, "s1")]
    near = words(7, 400, ENGLISH)
    rows += [(140, near, "en", "s1"), (141, near + " indeed", "en", "s1"), (142, "so " + near, "en", "s2")]
    rows += [(150, None, "en", "s0"), (151, "", None, None), (152, " \n ", "de", "s2"), (153, "123 456", "de", "s2")]
    rows += [(160, words(9, 20000, GERMAN), "de", "s3"), (None, words(5, 40, FRENCH), "fr", "s3")]
    rows += [(170, "tie tie", "en", "s2"), (170, "tie tie", "en", "s2"), (171, "tietie", "en", "s2")]
    return [(d, t, lang, s, None, "x", 1, "h", "no") for d, t, lang, s in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def bare(text: str | None) -> str:
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def exact_classes(rows):
    """Per row position: keep_id, group size, text hash; and which positions stay."""
    groups: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        groups.setdefault(bare(r[1]), []).append(i)
    told, stays = {}, set()
    for body, members in groups.items():
        best = min(members, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0, i))
        stays.add(best)
        for i in members:
            told[i] = (rows[best][0], len(members), hashlib.sha256(body.encode()).hexdigest())
    return told, stays


def fingerprint(text: str | None, size: int = 4) -> int:
    import xxhash

    ws = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    shingles = [" ".join(ws[i : i + size]) for i in range(len(ws) - size + 1)] or ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(n: int, edges) -> list[int]:
    """Smallest position reachable, by position."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_groups(prints: list[int], most: int) -> list[int]:
    distinct = sorted(set(prints))
    close = [(i, j) for i, a in enumerate(distinct) for j, b in enumerate(distinct[:i]) if (a ^ b).bit_count() <= most]
    roots = reach(len(distinct), close)
    number = {p: roots[i] for i, p in enumerate(distinct)}
    return [number[p] for p in prints]


def best_fit(lengths, capacity: int) -> int:
    """Sequences that best-fit decreasing opens."""
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def targets(sizes: dict, share=1.5, most=2.0) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not over:
            out.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def sainte_lague(weights: list[float], seats: int, most: list[int]) -> list[int]:
    got = [0] * len(weights)
    for _ in range(seats):
        best = max((i for i in range(len(weights)) if got[i] < most[i] and weights[i] > 0),
                   key=lambda i: (weights[i] / (2 * got[i] + 1), -i), default=None)
        if best is None:
            break
        got[best] += 1
    return got


def counted(rows) -> Counter:
    return Counter(map(tuple, rows))
