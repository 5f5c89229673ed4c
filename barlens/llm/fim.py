"""Fill-in-the-middle samples: texts cut at two ranks that an indexable skip list turns into code-point offsets."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlens.llm.common import batches_of, table, written

#: The markers, of 100 how many texts stay plain and how many of the others put the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_OF_100 = 10
SPM_OF_100 = 20
_MARKER = "<[PSM]>"
_FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


class Lanes:
    """Which units stand in which lane of a skip list: lane 0 has all, one in four of a lane stands in the next as well.

    A unit's height comes from its place alone, so lists are the same on every run, and lists of any length share these
    places; they grow with the longest text seen.
    """

    def __init__(self):
        self.n, self.at = 0, []

    def places(self, n: int) -> list[np.ndarray]:
        """Places of the units of each lane for a list of n units; the first unit stands in all of them."""
        if n > self.n:
            self.n = max(n, 2 * self.n, 4096)
            x = np.arange(self.n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x = x * np.uint64(0xBF58476D1CE4E5B9)
            self.at, at, lane = [np.arange(self.n)], np.arange(self.n), 0
            while len(at) > 4 and 2 * lane < 62:
                keep = (x[at] >> np.uint64(62 - 2 * lane)) & np.uint64(3) == 0
                keep[0] = True
                at, lane = at[keep], lane + 1
                self.at.append(at)
        out = []
        for at in self.at:
            out.append(at[:np.searchsorted(at, n)])
            if len(out[-1]) <= 4:
                break
        return out


class SkipList:
    """Units of a text with express lanes.  Every link carries how many units and how many code points it passes."""

    def __init__(self, lanes: Lanes, chars: np.ndarray | int):
        """``chars``: code points of each unit, or the number of units if each is one code point."""
        n = chars if isinstance(chars, int) else len(chars)
        ends = None if isinstance(chars, int) else np.concatenate([[0], np.cumsum(chars)])
        self.n, self.lanes = n, []
        below = None
        for at in (lanes.places(n) if n else []):
            to = np.append(at[1:], n)
            units = to - at
            self.lanes.append((units, units if ends is None else ends[to] - ends[at], None if below is None else np.searchsorted(below, at)))
            below = at

    def chars_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units: from the top lane down, each link is taken that does not pass the rank."""
        passed = chars = node = 0
        for units, widths, down in reversed(self.lanes):
            while node < len(units) and passed + units[node] <= rank:
                passed, chars, node = passed + int(units[node]), chars + int(widths[node]), node + 1
            if passed == rank:
                break
            if down is not None:
                node = int(down[node])
        assert passed == rank, "a rank lies within the list"
        return chars


def drawn(doc_id: Column, salt: str = "1") -> list[Column]:
    """Four unsigned 32-bit numbers of an id: the first hex groups of the SHA-256 of ``salt:id``; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _cutter(columns: int, unit: str | None, plain: int, spm: int):
    """A function over Arrow batches of (columns ..., _h1, _h2, _h3, _h4, _text)."""
    pattern = None if unit is None else re.compile(unit, re.DOTALL)

    def cut(batches):
        lanes = Lanes()
        for batch in batches:
            h = [batch.column(columns + i).to_pylist() for i in range(4)]
            rows = []
            for i, text in enumerate(batch.column(columns + 4)):
                text = text.as_py()
                if pattern is None:
                    n = chars = len(text)
                else:
                    chars = np.array([m.end() - m.start() for m in pattern.finditer(text)], dtype=np.int64)
                    n = len(chars)
                    if chars.sum() != len(text) or (n and chars.min() == 0):
                        raise ValueError("the units must cover the text and not be empty")
                if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2][i] % 100 >= 100 - plain:
                    rows.append((n, "plain", None, None, text))
                    continue
                units = SkipList(lanes, chars)
                a, b = (units.chars_before(r) for r in sorted((h[0][i] % (n + 1), h[1][i] % (n + 1))))
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                if h[3][i] % 100 < spm:
                    rows.append((n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"))
                else:
                    rows.append((n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"))
            made = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], *[pa.array(v, t) for v, t in zip(made, types)]],
                                             [*[f"c{i}" for i in range(columns)], "n", "form", "prefix_chars", "middle_chars", "output"])
    return cut


def fill_in_middle(docs: DataFrame, unit: str | None = None, plain: int = PLAIN_OF_100, spm: int = SPM_OF_100, salt: str = "1") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of (doc_id, text).

    A text is cut into units, code points unless ``unit`` gives a pattern whose matches from left to right cover it.  Two
    ranks among 0 .. n, drawn from the id, are found through the skip list, so the middle begins and ends at a unit;
    prefix_chars and middle_chars are code points, n counts units.  ``plain`` of 100 texts stay as they are, ``spm`` of 100 others put the suffix first.

    Null and empty texts and texts with a marker are plain, with null lengths; a null id draws as an empty id; rows that
    repeat an id are cut alike; both ranks may be equal or at an edge, then parts are empty; extra columns are left out.
    One pass without shuffle; a worker holds one Arrow batch (512 rows or 8 MB, or one longer text) and its list.
    """
    h = drawn(F.col("doc_id"), salt)
    given = docs.select("doc_id", *[x.alias(f"_h{i + 1}") for i, x in enumerate(h)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(_cutter(1, unit, plain, spm), f"c0 {kind}, {_FIELDS}").withColumnRenamed("c0", "doc_id")


def restored(output: Column, form: Column) -> Column:
    """The text a sample was made of, from the sample and its form alone."""
    part = F.split(output, _MARKER, -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the samples of all documents and of the texts rebuilt from them; bits of UTF-8, lower-case hex."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    out = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
    with batches_of(spark):
        return written(out, "fim")


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p
"""
