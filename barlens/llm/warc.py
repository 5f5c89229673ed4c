"""Legacy ARC archives to WARC: writing, parsing, converting, reading back."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barlens.llm.common import batches_of, discard, remove, table, written
from barlens.session import shared_dir

#: Fixed values of the formats.  ARC: name of the first record, fields of a header line by version.  WARC: line end, revisit profile.
FILEDESC = "filedesc://"
ARC_FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"),
}
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file holds at most so many records, and about so many bytes of payload unless a single one is longer.
RECORDS_PER_FILE = 5000
BYTES_PER_FILE = 128 << 20
_ID_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for URLs of RFC 4122

RECORD = "page_id long, url string, ip string, date string, content_type string, payload binary"
WARC_RECORD = ("record_id string, record_type string, target_uri string, warc_date string, ip string, content_type string, "
               "payload_digest string, refers_to_id string, refers_to_uri string, refers_to_date string, page_id long, refers_to_page long, "
               "payload_bytes long, payload binary")


# ---- ARC -----------------------------------------------------------------------------------------------------------------

def arc_lines(records: DataFrame, version: Column) -> Column:
    """An ARC record as text: header line of the version, declared length, payload.  Blanks in a URL are written as %20."""
    def word(c, empty="-"):
        return F.when(F.coalesce(c, F.lit("")) == "", F.lit(empty)).otherwise(F.regexp_replace(c, r"[\x00-\x20\x7f]", "%20"))
    n = F.octet_length("payload").cast("string")
    one = F.concat_ws(" ", word(F.col("url")), F.coalesce("ip", F.lit("0.0.0.0")), F.col("date"), word(F.col("content_type"), "no-type"), n)
    two = F.concat_ws(" ", word(F.col("url")), F.coalesce("ip", F.lit("0.0.0.0")), F.col("date"), word(F.col("content_type"), "no-type"),
                      F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.concat(F.lit("p"), F.coalesce(F.col("page_id").cast("string"), F.lit("-"))), n)
    # the text writer puts bytes out as they are
    return F.concat(F.when(version == 1, one).otherwise(two), F.lit("\n"), F.expr("cast(payload as string)"))


def _places(size: Column, records_per_file: int) -> list[Column]:
    """Two folder numbers that bound a file by records and by bytes, without a pass over the sizes.

    Records of a size class, each 16 times the one before, share a window of a task's row numbers; a window has as many
    numbers as records of the largest size of its class fit into a file.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    tops = [BYTES_PER_FILE // RECORDS_PER_FILE * 16 ** i for i in range(4)]
    kind, window = F.lit(len(tops)), row
    for i, top in reversed(list(enumerate(tops))):
        kind = F.when(size <= top, i).otherwise(kind)
        window = F.when(size <= top, F.floor(row / min(records_per_file, max(BYTES_PER_FILE // top, 1)))).otherwise(window)
    return [kind.alias("_class"), window.cast("long").alias("_window")]


def write_arc(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, version: int | None = None) -> None:
    """Write (page_id, url, ip, date, content_type, payload) as gzipped ARC files, in one pass.

    ``version`` 1 or 2; None writes even page ids in version 1 and the rest in version 2.  The id goes into the file name field of
    version 2 and, as version 1 has none, into the fragment of its URL.
    """
    v = F.lit(version) if version else F.when(F.col("page_id") % 2 == 0, 1).otherwise(2)
    records = records.withColumn("_v", v).withColumn("url", F.when(F.col("_v") == 1, F.concat(
        F.coalesce("url", F.lit("")), F.lit("#arc-id="), F.coalesce(F.col("page_id").cast("string"), F.lit("-")))).otherwise(F.col("url")))
    heads = {}
    for which in (1, 2):
        body = f"{which} 0 archive\n{' '.join(_TITLES[which])}\n"
        heads[which] = F.lit(f"{FILEDESC}records.arc 0.0.0.0 19960101000000 text/plain " + ("200 - - 0 records.arc " if which == 2 else "") + f"{len(body)}\n{body}\n")
    # the version block stands before every record, as the writer decides where a file begins
    head = F.when(F.col("_v") == 1, heads[1]).otherwise(heads[2])
    (records.select("_v", *_places(F.octet_length("payload"), records_per_file), F.concat(head, arc_lines(records, F.col("_v"))).alias("value"))
     .write.partitionBy("_v", "_class", "_window").option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


_TITLES = {1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
           2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")}


class _Stream:
    """Bytes of a file, unpacked piece by piece if gzipped (one or many members)."""

    def __init__(self, raw: bytes, piece: int = 1 << 20):
        self.raw, self.at, self.piece, self.have, self.pos = raw, 0, piece, b"", 0
        self.zip = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        while self.at < len(self.raw):
            chunk = self.raw[self.at:self.at + self.piece]
            self.at += len(chunk)
            if self.zip is not None:
                out = self.zip.decompress(chunk)
                if self.zip.eof:
                    self.at -= len(self.zip.unused_data)
                    self.zip = zlib.decompressobj(31)
                chunk = out
            if chunk:
                self.have, self.pos = self.have[self.pos:] + chunk, 0
                return True
        return False

    def take(self, n: int) -> bytes:
        if len(self.have) - self.pos < n:
            parts, got = [self.have[self.pos:]], len(self.have) - self.pos
            self.have, self.pos = b"", 0
            while got < n and self._more():
                parts.append(self.have)
                got += len(self.have)
                self.have = b""
            self.have, self.pos = b"".join(parts), 0
        out = self.have[self.pos:self.pos + n]
        self.pos += len(out)
        return out

    def line(self) -> bytes | None:
        """Next line without its end; None at the end of the file."""
        while (i := self.have.find(b"\n", self.pos)) < 0:
            if not self._more():
                if self.pos >= len(self.have):
                    return None
                i = len(self.have)
                break
        out, self.pos = self.have[self.pos:i], i + 1
        return out.rstrip(b"\r")


def parse_arc(raw: bytes) -> Iterator[dict]:
    """Records of one ARC file.  A version block tells how the header lines after it are laid out; payloads go by declared length.

    Lines that are no header (a length that is no number, too few fields) are passed over until the next that is one.
    """
    stream, fields = _Stream(raw), ARC_FIELDS[1]
    while (line := stream.line()) is not None:
        words = line.decode("utf-8", "replace").split(" ")
        if words[0].startswith(FILEDESC) and words[-1].isdigit():
            body = stream.take(int(words[-1]))
            version = body[:1].decode("latin-1")
            fields = ARC_FIELDS.get(int(version) if version.isdigit() else 1, ARC_FIELDS[1])
            continue
        if len(words) < len(fields) or not words[-1].isdigit():
            continue
        extra = len(words) - len(fields)  # blanks inside the first field
        values = [" ".join(words[:extra + 1]), *words[extra + 1:]]
        rec = dict(zip(fields, values))
        rec["payload"] = stream.take(int(rec["length"]))
        yield rec


def _arc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("content"):
            rows, total = [], 0
            for r in parse_arc(raw.as_buffer().to_pybytes()):
                url, doc = r["url"], r.get("filename", "-")
                if "filename" not in r:
                    url, _, doc = url.rpartition("#arc-id=")
                    doc = f"p{doc}"
                rows.append((int(doc[1:]) if doc[1:].lstrip("-").isdigit() else None, None if url in ("", "-") else url, r["ip"], r["date"],
                             None if r["content_type"] == "no-type" else r["content_type"], r["payload"]))
                total += len(r["payload"])
                if total > 8 << 20:
                    yield _table(rows, RECORD)
                    rows, total = [], 0
            if rows:
                yield _table(rows, RECORD)


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    cols = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[k]) for i, (_, k) in enumerate(cols)], names=[n for n, _ in cols])


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")


def read_arc(spark, path: str) -> DataFrame:
    """Records of all ARC files under a path; a file is one task's work, so writers bound its records and bytes."""
    return _files(spark, path).mapInArrow(_arc_records, RECORD)


# ---- ARC to WARC ---------------------------------------------------------------------------------------------------------

_SYNTHESISED = ("record_id string, target_uri string, warc_date string, ip string, content_type string, payload_digest string, page_id long, "
                "_sha binary, _n long, payload binary")


def _synthesised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identifier, time stamp and digest of the equivalent WARC record, from what the ARC record says and holds; one pass over the payload."""
    for batch in batches:
        out = []
        for page, url, ip, date, kind, payload in zip(*[c.to_pylist() for c in batch.columns]):
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            d = (date or "").ljust(14, "0")[:14]
            stamp = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z" if d.isdigit() else "1996-01-01T00:00:00Z"
            name = f"{url or ''} {d} {digest} {'' if page is None else page}"
            out.append((f"<urn:uuid:{uuid.uuid5(_ID_SPACE, name)}>", url or "urn:unknown", stamp, ip, kind or "application/octet-stream", digest, page,
                        hashlib.sha256(payload).digest(), len(payload), payload))
        yield _table(out, _SYNTHESISED)


def _numbered(record_id: Column, number: Column) -> Column:
    """Another identifier for a record that repeats one: from the identifier and a number of its own."""
    h = F.md5(F.concat(record_id, F.lit(" "), number.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a + 1, n) for a, n in ((0, 8), (8, 4), (12, 4), (16, 4), (20, 12))]), F.lit(">"))


def to_warc(arc: DataFrame, smallest: int = 0) -> DataFrame:
    """Equivalent WARC records.  Of records with equal payloads (of at least ``smallest`` bytes) the one with the largest page id is
    the response, the others revisit it and carry no payload.  Equal means equal SHA-256 and length.  Of rows that repeat
    an id with the same payload one is the response, and records that would share an identifier get another one each; a null id comes last in the choice.

    The records are parsed and hashed once, into a table.  Choosing reads its narrow columns only: the maximum is taken before the shuffle,
    so a payload that a third of all pages have is one row per task.  Revisits are made of these columns; of the others only the
    numbers of the rows that are no response meet the payloads, in a join that Spark makes a broadcast where it finds them small.
    """
    parsed = written(arc.mapInArrow(_synthesised, _SYNTHESISED).withColumn("_row", F.monotonically_increasing_id()), "warc-parsed")
    keys = parsed.drop("payload")
    twice = written(keys.groupBy("record_id").agg(F.count("*").alias("_times"), F.min("_row").alias("_least")).where("_times > 1").drop("_times"), "warc-twice")
    salt = F.pmod(F.col("_row"), F.lit(16))
    spread = twice.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    keys = (keys.withColumn("_salt", salt).join(spread, ["record_id", "_salt"], "left")
            .withColumn("record_id", F.when(F.col("_row") > F.col("_least"), _numbered(F.col("record_id"), F.col("_row"))).otherwise(F.col("record_id"))))
    keys = keys_table = written(keys.drop("_salt", "_least"), "warc-keys")
    same = ["_sha", "_n"]
    best = keys.where(F.col("_n") >= smallest).groupBy(*same).agg(
        F.count("*").alias("_times"), F.max(F.struct("page_id", "_row", "record_id", "target_uri", "warc_date")).alias("_best"))
    best = written(best.where("_times > 1").select(F.sha2(F.concat("_sha", F.col("_n").cast("string").cast("binary")), 256).alias("_key"), "_best"), "warc-best")
    pick = best.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    revisits = written(keys.withColumns({"_key": F.sha2(F.concat("_sha", F.col("_n").cast("string").cast("binary")), 256), "_salt": salt})
                       .join(pick, ["_key", "_salt"]).where("_row <> _best._row"), "warc-revisits")
    names = ["record_id", "target_uri", "warc_date", "ip", "content_type", "payload_digest"]
    no = F.lit(None).cast("string")
    first = parsed.join(revisits.select("_row"), "_row", "left_anti")
    if not twice.isEmpty():
        first = first.join(keys.select("_row", F.col("record_id").alias("_id")), "_row").withColumn("record_id", F.col("_id")).drop("_id")
    responses = first.select(*names, F.lit("response").alias("record_type"), no.alias("refers_to_id"), no.alias("refers_to_uri"), no.alias("refers_to_date"),
                             "page_id", F.lit(None).cast("long").alias("refers_to_page"), F.col("_n").alias("payload_bytes"), "payload")
    again = revisits.select(*names, F.lit("revisit").alias("record_type"), F.col("_best.record_id").alias("refers_to_id"), F.col("_best.target_uri").alias("refers_to_uri"),
                            F.col("_best.warc_date").alias("refers_to_date"), "page_id", F.col("_best.page_id").alias("refers_to_page"),
                            F.col("_n").alias("payload_bytes"), F.lit(b"").alias("payload"))
    out = responses.unionByName(again).select(*[c.split()[0] for c in WARC_RECORD.split(", ")])
    out._tables = [parsed, twice, keys_table, best, revisits]  # for who is done with the records
    return out


# ---- WARC ----------------------------------------------------------------------------------------------------------------

def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write WARC/1.1 records as gzipped files: header, empty line, payload of the declared length, two line ends.

    A revisit tells in extension fields the page it refers to and the length of the payload that it leaves out.
    """
    def field(name, value):
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    head = F.concat(
        F.lit("WARC/1.1" + CRLF), field("WARC-Type", F.col("record_type")), field("WARC-Record-ID", F.col("record_id")), field("WARC-Date", F.col("warc_date")),
        field("WARC-Target-URI", F.col("target_uri")), field("WARC-IP-Address", F.col("ip")), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        field("WARC-Profile", F.when(revisit, F.lit(PROFILE))), field("WARC-Refers-To", F.col("refers_to_id")), field("WARC-Refers-To-Target-URI", F.col("refers_to_uri")),
        field("WARC-Refers-To-Date", F.col("refers_to_date")), field("X-Page-ID", F.col("page_id").cast("string")),
        field("X-Refers-To-Page-ID", F.col("refers_to_page").cast("string")), field("X-Payload-Length", F.when(revisit, F.col("payload_bytes").cast("string"))),
        field("Content-Type", F.col("content_type")),
        field("Content-Length", F.octet_length("payload").cast("string")), F.lit(CRLF))
    (records.select(*_places(F.octet_length("payload"), records_per_file), F.concat(head, F.expr("cast(payload as string)")).alias("value"))
     .write.partitionBy("_class", "_window").option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def parse_warc(raw: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields, payload) of each record of one file, by declared length."""
    stream = _Stream(raw)
    while (line := stream.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.take(int(fields.get("content-length", 0)))


def _warc_records(payloads: bool):
    kinds = WARC_RECORD if payloads else WARC_RECORD.rpartition(", ")[0]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                rows, total = [], 0
                for f, payload in parse_warc(raw.as_buffer().to_pybytes()):
                    g, n = f.get, len(payload)
                    digest = g("warc-payload-digest", "").removeprefix("sha1:")
                    if g("warc-type") == "revisit":
                        n = int(g("x-payload-length", 0))
                    elif digest and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                        raise ValueError(f"the payload of {g('warc-record-id')} does not have the digest of its header")
                    rows.append((g("warc-record-id"), g("warc-type"), g("warc-target-uri"), g("warc-date"), g("warc-ip-address"), g("content-type"),
                                 digest, g("warc-refers-to"), g("warc-refers-to-target-uri"), g("warc-refers-to-date"),
                                 *[int(f[x]) if x in f else None for x in ("x-page-id", "x-refers-to-page-id")], n, *([payload] if payloads else [])))
                    total += len(payload) if payloads else 500
                    if total > 8 << 20:
                        yield _table(rows, kinds)
                        rows, total = [], 0
                if rows:
                    yield _table(rows, kinds)
    return records


def read_warc(spark, path: str, payloads: bool = True) -> DataFrame:
    """Records of all WARC files under a path.  Payloads are read and held against their digests in any case, and returned if asked for."""
    return _files(spark, path).mapInArrow(_warc_records(payloads), WARC_RECORD if payloads else WARC_RECORD.rpartition(", ")[0])


# ---- the query -----------------------------------------------------------------------------------------------------------

def archived(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """Pages through ARC files and WARC files and back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    pages (page_id, url, html) become ARC records of both versions, written, parsed by header version and declared length, converted,
    written as WARC and read again, each once.  Null html is an empty payload; null or blank URLs and repeated rows are kept, and of
    repeated rows one is the response; a revisit's size is that of the payload it refers to; an empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    root = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex[:12]}"
    # the pages have no crawl time: seconds since 1996 by id, as a 14-digit stamp
    stamp = F.date_format(F.timestamp_seconds(F.lit(820454400) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(900_000_000))), "yyyyMMddHHmmss")
    records = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.lit("0.0.0.0").alias("ip"), stamp.alias("date"),
                           F.lit("text/html").alias("content_type"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    with batches_of(spark):
        write_arc(records, f"{root}/arc")
        records = to_warc(read_arc(spark, f"{root}/arc"), smallest)
        write_warc(records, f"{root}/warc")
        discard(*records._tables)
        back = read_warc(spark, f"{root}/warc", payloads=False)
        back = written(back.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to")), "warc-back")
    remove(spark, root)
    return back


def op9_warc(spark, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))
