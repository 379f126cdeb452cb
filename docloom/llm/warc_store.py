"""Content-addressed web archive.

Payload bytes are kept once under their SHA-256; exact WARC record heads are
kept apart, one a record, and name the digest. Joining the two gives every
original record again, byte for byte. Nothing leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .storage import Scratch

_CRLF = "\r\n"
#: Payloads below this many bytes are never revisited.
REVISIT_BYTES = 1000


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))


def _head(date: str) -> Column:
    """The WARC header block and the HTTP header of one record, as text."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}"), _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(_CRLF))
    revisit = F.col("record_type") == "revisit"
    body = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")
    return F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To", _record_id(F.col("refers_to"))))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", body.cast("string")),
        F.lit(_CRLF),
        http,
    )


@dataclass(frozen=True)
class WarcArchive:
    """An archive in a folder: ``payloads`` and ``heads``.

    Input needs ``page_id`` (long), ``url`` and ``html``; other columns are
    ignored. A null html is an empty payload. Of equal payloads of at least
    ``REVISIT_BYTES`` the record with the largest page_id is the response and the
    others revisit it; repeated rows with that page_id are all responses, and
    where every page_id is null all are. An empty table gives an empty archive.
    """

    scratch: Scratch
    date: str = "2024-01-01T00:00:00Z"

    def write(self, pages: DataFrame) -> WarcArchive:
        raw = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
        raw = raw.withColumns({"digest": F.sha2("payload", 256), "payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
        index = self.scratch.write(raw.drop("payload"), "index")
        owner = index.where(f"payload_bytes >= {REVISIT_BYTES}").groupBy("digest").agg(F.max("page_id").alias("owner"))
        heads = index.join(owner, "digest", "left")
        is_revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
        heads = heads.withColumn("record_type", F.when(is_revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(is_revisit, F.col("owner")))
        self.scratch.write(heads.select("page_id", "digest", F.encode(_head(self.date), "UTF-8").alias("head")), "heads")
        # one copy of each payload leaves each task, one is kept
        self.scratch.write(raw.select("digest", "payload_digest", "payload").groupBy("digest").agg(F.first("payload").alias("payload"), F.min("payload_digest").alias("low"), F.max("payload_digest").alias("high")), "payloads")
        self.scratch.drop("index")
        return self

    def payloads(self) -> DataFrame:
        """``digest, payload``; stops on bytes that don't match their digest, or two payloads under one."""
        kept = self.scratch.read("payloads")
        sound = (F.sha2("payload", 256) == F.col("digest")) & (F.col("low") == F.col("high")) & (F.sha1("payload") == F.col("low"))
        checked = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "digest")).cast("binary"))
        return kept.select("digest", checked.alias("payload"))

    def records(self) -> DataFrame:
        """Original records: ``page_id, head, payload``, the payload joined back for revisits too."""
        return self.scratch.read("heads").join(self.payloads(), "digest").select("page_id", "head", "payload")

    @staticmethod
    def warc_bytes() -> Column:
        """One record as it stands in a WARC file; revisits carry no payload."""
        body = F.when(WarcArchive.field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
        return F.concat("head", body, F.lit(b"\r\n\r\n"))

    @staticmethod
    def field(name: str) -> Column:
        """A named field of a record's head."""
        return _field(F.decode("head", "UTF-8"), name)


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def parse_records(records: DataFrame, column: str) -> DataFrame:
    """Reads whole WARC records (bytes): adds ``head`` (text) and ``body``, the payload that the record itself holds.

    A record whose lengths or ends don't fit stops the query.
    """
    end = "\r\n\r\n"
    out = records.withColumn("_s", F.decode(F.col(column), "ISO-8859-1"))  # a character a byte
    out = out.withColumn("_at", F.instr("_s", end)).withColumn("_head", F.substring("_s", F.lit(1), F.col("_at") + 3))
    out = out.withColumn("_size", _field(F.col("_head"), "Content-Length").try_cast("int"))
    out = out.withColumn("_block", F.substring("_s", F.col("_at") + 4, F.col("_size"))).withColumn("_http", F.instr("_block", end))
    sound = F.col("_s").startswith("WARC/1.1\r\n") & (F.col("_at") > 0) & (F.col("_http") > 0) & (F.length("_s") == F.col("_at") + 3 + F.col("_size") + 4) & F.col("_s").endswith(end)
    body = F.encode(F.substring("_block", F.col("_http") + 4, F.length("_block")), "ISO-8859-1")
    checked = F.when(F.coalesce(sound, F.lit(False)), body).otherwise(F.raise_error(F.lit("damaged record")).cast("binary"))
    head = F.decode(F.encode("_head", "ISO-8859-1"), "UTF-8")
    return out.withColumns({"head": head, "body": checked}).drop("_s", "_at", "_head", "_size", "_block", "_http")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write an archive of the pages, put its records together, read them as WARC, and tell of each what came back."""
    archive = WarcArchive(Scratch(spark, "warc")).write(pages)
    back = parse_records(archive.records().select("page_id", "payload", WarcArchive.warc_bytes().alias("record")), "record")
    kind = _field(F.col("head"), "WARC-Type")
    # a revisit's payload is the one it names, which the join has brought
    back = back.withColumn("record_type", kind).withColumn("_full", F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(F.col("body")))
    refers = F.regexp_extract(_field(F.col("head"), "WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1)
    back = back.select(
        "page_id",
        F.octet_length("_full").cast("long").alias("payload_bytes"),
        F.sha1("_full").alias("payload_digest"),
        "record_type",
        F.when(refers != "", refers.try_cast("long")).alias("refers_to"),
        _field(F.col("head"), "WARC-Payload-Digest").alias("_said"),
    )
    same = F.col("_said") == F.concat(F.lit("sha1:"), "payload_digest")
    return back.withColumn("payload_digest", F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("digest in head differs")).cast("string"))).drop("_said")
