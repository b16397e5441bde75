"""Content-addressed web archive: payload bytes once, record headers apart, records rebuilt by joins.

The archive has two tables in one folder:

- ``payloads``: one row for each distinct payload, under its SHA-256; the length and a SHA-1 are kept beside it,
  and all three are computed again from the stored bytes when the archive is read.
- ``headers``: one row for each record: the exact WARC/1.1 header block, and the key of its payload.

Reading puts each record's bytes together again (header block, blank line, body, two line ends), parses them, and checks the body's length against Content-Length
and its SHA-1, for a revisit that of the payload it refers to, against the digest that the header names. What it returns comes from these bytes.

Of records with equal payloads of at least ``min_revisit_bytes`` bytes, the one with the largest id is the
response and the others are revisits that refer to it. Smaller payloads are stored once as well, but each of
their records is a response. A null html is an empty payload. A null url gives no target header; one that a header line can't hold as it is (empty, with line ends
or with white space at its ends) is percent-encoded there and kept exactly in a header of its own. Rows with a null
id are kept and never refer to others. Repeated ids (ties) each get a record; all rows of the largest id are responses. Empty
tables give empty archives. Extra columns are ignored.

Scale: copies meet by partial aggregation, so a payload that a third of all rows share crosses the network once a
task; payload bytes are shuffled when the store is made and when responses are put together, once for each different payload (shared.SALTS times at most for a small one
that very many records have). Both tables say in which parts (shared.salt of the page's id) a payload's records are, so joins are dealt to parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm.shared import each_salt, only, salt, salts

MIN_REVISIT_BYTES = 1000
CRLF = "\r\n"
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_urn(record_id: Column) -> Column:
    """A name-based UUID for a record, from its id."""
    h = F.md5(F.concat(F.lit("record:"), F.coalesce(record_id.cast("string"), F.lit(""))).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def header_block(uri: Column, sha1: Column, n_bytes: Column, kind: Column, refers_to: Column, record_id: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    plain = F.regexp_replace(F.regexp_replace(F.trim(uri), "\r", "%0D"), "\n", "%0A")
    exact = F.when(uri.rlike(r"[\r\n]|^\s|\s$") | (uri == ""), line("X-Target-URI-Base64", F.translate(F.base64(uri.cast("binary")), CRLF, "")))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_urn(record_id)),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(F.when(uri.isNotNull(), line("WARC-Target-URI", plain)), F.lit("")),
        F.coalesce(exact, F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(
            kind == "revisit",
            F.concat(
                line("WARC-Profile", F.lit(REVISIT_PROFILE)),
                line("WARC-Refers-To", record_urn(refers_to)),
                line("X-Refers-To-Page", refers_to.cast("string")),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(kind == "revisit", F.lit(0)).otherwise(n_bytes).cast("string")),
        line("X-Payload-Length", n_bytes.cast("string")),
        line("X-Page", F.coalesce(record_id.cast("string"), F.lit(""))),
    )


def header_value(header: Column, name: str) -> Column:
    """The value of a header line, null where there is none."""
    return F.when(header.rlike(rf"(?m)^{name}: "), F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)", 1))


def _bit(page_id: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), salt(page_id))


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    rows = only(pages, "page_id", "url", "html").withColumn("payload", F.coalesce("html", F.lit("")).cast("binary"))
    keyed = rows.withColumn("payload_key", F.sha2("payload", 256))
    (
        keyed.groupBy("payload_key")
        .agg(F.max("page_id").alias("holder"), F.first("payload").alias("payload"), salts("page_id").alias("parts"))
        .withColumn("n_bytes", F.octet_length("payload").cast("long"))
        .withColumn("sha1", F.sha1("payload"))
        .withColumn("body_parts", F.when(F.col("n_bytes") < min_revisit_bytes, F.col("parts")).otherwise(F.col("parts").bitwiseAND(_bit(F.col("holder")).bitwiseOR(_bit(F.lit(None).cast("bigint"))))))
        .write.option("compression", "zstd")
        .parquet(f"{path}/payloads")
    )
    held = pages.sparkSession.read.parquet(f"{path}/payloads").select("payload_key", "holder", "n_bytes", "sha1", each_salt(F.col("parts")).alias("part"))
    records = (
        keyed.select("page_id", "url", "payload_key", salt("page_id").alias("part"))
        .join(held, ["payload_key", "part"])
        .withColumn("kind", F.when((F.col("n_bytes") >= min_revisit_bytes) & (F.col("page_id") != F.col("holder")), "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(F.col("kind") == "revisit", F.col("holder")))
    )
    records.select(
        header_block(F.col("url"), F.col("sha1"), F.col("n_bytes"), F.col("kind"), F.col("refers_to"), F.col("page_id"))
        .cast("binary")
        .alias("header"),
        "payload_key",
        "part",
        (F.col("kind") != "revisit").alias("has_body"),
    ).write.option("compression", "zstd").parquet(f"{path}/headers")


def _wrong(what: str, key: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what}: "), key))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: its bytes (record), what they say, and the payload (null for a revisit: it is that of the record it refers to). A payload that doesn't match its
    key, or a record that doesn't match its payload, stops the read."""
    key = F.col("payload_key")
    stored = spark.read.parquet(f"{path}/payloads")
    stored = stored.select(
        F.when(F.sha2("payload", 256) == key, key).otherwise(_wrong("payload is damaged", key)).alias("payload_key"),
        F.octet_length("payload").cast("long").alias("real_bytes"),
        F.sha1("payload").alias("real_sha1"),
        "payload",
        "parts",
        "body_parts",
    )
    headers, at = spark.read.parquet(f"{path}/headers"), ["payload_key", "part"]
    facts = ["payload_key", "real_bytes", "real_sha1"]
    bodies = stored.select(*facts, "payload", each_salt(F.col("body_parts")).alias("part"))
    known = stored.select(*facts, F.lit(None).cast("binary").alias("payload"), each_salt(F.col("parts")).alias("part"))
    both = headers.where("has_body").join(bodies, at).unionByName(headers.where("NOT has_body").join(known, at))
    records = both.withColumn("record", record_bytes(F.col("header"), F.col("payload")))
    # The header block ends at the first blank line; the two line ends after the body are no part of it.
    end = F.instr(F.col("record").cast("string"), CRLF * 2)
    head = F.substring(F.col("record").cast("string"), F.lit(1), end + 1)
    size = F.octet_length(head) + len(CRLF)
    body = F.substring(F.col("record"), size + 1, F.octet_length("record") - size - 2 * len(CRLF))
    parsed = records.select("payload_key", "payload", "real_bytes", "real_sha1", "record", head.alias("head"), body.alias("body"))
    said = parsed.select(
        "*",
        header_value(F.col("head"), "X-Page").alias("page"),
        header_value(F.col("head"), "WARC-Target-URI").alias("uri"),
        F.unbase64(header_value(F.col("head"), "X-Target-URI-Base64")).cast("string").alias("exact_uri"),
        header_value(F.col("head"), "WARC-Type").alias("record_type"),
        header_value(F.col("head"), "X-Refers-To-Page").cast("long").alias("refers_to"),
        F.substring_index(header_value(F.col("head"), "WARC-Payload-Digest"), "sha1:", -1).alias("payload_digest"),
        header_value(F.col("head"), "X-Payload-Length").cast("long").alias("payload_bytes"),
        header_value(F.col("head"), "Content-Length").cast("long").alias("length"),
    )
    revisit = F.col("record_type") == "revisit"
    whole = F.octet_length("body").cast("long") == F.col("length")
    fits = F.when(revisit, (F.col("length") == 0) & (F.col("real_sha1") == F.col("payload_digest"))).otherwise((F.sha1("body") == F.col("payload_digest")) & (F.col("length") == F.col("payload_bytes")))
    fits = F.coalesce(whole & fits & (F.col("payload_bytes") == F.col("real_bytes")), F.lit(False))
    return said.select(
        F.when(fits, F.when(F.col("page") != "", F.col("page").cast("long"))).otherwise(_wrong("record and payload differ", key).cast("long")).alias("page_id"),
        F.coalesce("exact_uri", "uri").alias("url"),
        "record_type",
        "refers_to",
        "payload_bytes",
        "payload_digest",
        "payload",
        "record",
    )


def record_bytes(header: Column, payload: Column) -> Column:
    """The original record: header block, blank line, body (none for a revisit), two line ends."""
    body = F.when(header.cast("string").contains(f"WARC-Type: revisit{CRLF}"), F.lit(b"")).otherwise(payload)
    return F.concat(header, F.lit(CRLF.encode()), body, F.lit((CRLF * 2).encode()))
