"""File ingest: decode, route, normalise, split by role, summarise.

``files`` has job_id, pos, filename, mime, role and a base64 ``payload``. Every step is a narrow projection except the
role concat, which first drops the rows that lie wholly behind the clip, so no job is gathered beyond ``max_chars``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.jsontext import is_json
from quire.functions.windows import ordered, ordered_text

# Size limit and the type tables of the router.
MAX_FILE_BYTES = 50_000_000
TEXT_EXT = ["txt", "md", "csv", "html", "htm", "xml", "yaml", "yml"]
DOCX_EXT, PPTX_EXT, XLSX_EXT = ["docx", "doc"], ["pptx", "pptm", "ppsx"], ["xlsx", "xlsm", "xltx", "xltm"]
IMAGE_EXT = ["png", "jpg", "jpeg", "webp", "gif", "bmp", "tiff"]
OOXML = "application/vnd.openxmlformats-officedocument."
DOCX_MIME = [OOXML + "wordprocessingml.document", "application/msword"]
PPTX_MIME = [
    OOXML + "presentationml.presentation",
    OOXML + "presentationml.slideshow",
    "application/vnd.ms-powerpoint.presentation.macroenabled.12",
]
XLSX_MIME = [
    OOXML + "spreadsheetml.sheet",
    OOXML + "spreadsheetml.template",
    "application/vnd.ms-excel.sheet.macroenabled.12",
]


def file_table(spark: SparkSession, path: str, job: Column, role: Column) -> DataFrame:
    """A manifest from files on disk: the binary source lists and reads them in parallel."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    return raw.select(
        job.alias("job_id"),
        F.xxhash64("path").alias("pos"),
        name.alias("filename"),
        F.lit("").alias("mime"),
        role.alias("role"),
        F.base64("content").alias("payload"),
    )


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of every file under a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def decode_payload(payload: Column) -> Column:
    """Bytes of a base64 payload, null when it is not valid."""
    return F.try_to_binary(payload, F.lit("base64"))


def bytes_to_text(raw: Column) -> Column:
    """UTF-8, else UTF-16 when a byte-order mark is present, else Latin-1."""
    mark = F.hex(F.substring(raw, 1, 2))
    # Latin-1 decodes any bytes; UTF-16 is only tried behind its mark.
    return (
        F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
        .when(mark.isin("FEFF", "FFFE"), F.decode(raw, "UTF-16"))
        .otherwise(F.decode(raw, "ISO-8859-1"))
    )


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"[^/.][^/]*\.([^./]+)$", 1))


def route(filename: Column, mime: Column) -> Column:
    """text, json, docx, pptx, xlsx, pdf, image or fallback: the MIME type or the extension, in this order."""
    m, e = F.lower(F.coalesce(mime, F.lit(""))), extension(filename)
    return (
        F.when(m.startswith("text/") | e.isin(TEXT_EXT), "text")
        .when((m == "application/json") | (e == "json"), "json")
        .when(m.isin(DOCX_MIME) | e.isin(DOCX_EXT), "docx")
        .when(m.isin(PPTX_MIME) | e.isin(PPTX_EXT), "pptx")
        .when(m.isin(XLSX_MIME) | e.isin(XLSX_EXT), "xlsx")
        .when((m == "application/pdf") | (e == "pdf"), "pdf")
        .when(m.startswith("image/") | e.isin(IMAGE_EXT), "image")
        .otherwise("fallback")
    )


def normalise_json(text: Column) -> Column:
    """Compact JSON; text that is no JSON stays as it is."""
    return F.when(is_json(text), F.to_json(F.try_parse_json(text))).otherwise(text)


def _filled(c: str, default: str, limit: int) -> Column:
    return F.substring(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)), 1, limit)


def ingest(files: DataFrame, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Per file: status, error, byte length, route and text (null for failed files and for binary routes)."""
    rows = files.select(
        "job_id",
        "pos",
        _filled("filename", "unnamed", 260).alias("filename"),
        _filled("mime", "application/octet-stream", 200).alias("mime"),
        F.lower(T.strip(F.coalesce(F.nullif("role", F.lit("")), F.lit("content")))).alias("role"),
        decode_payload(F.col("payload")).alias("raw"),
    )
    rows = rows.withColumn("bytes", F.octet_length("raw")).withColumn("route", route(F.col("filename"), F.col("mime")))
    error = F.when(F.col("raw").isNull(), "Invalid base64 file payload").when(
        F.col("bytes") > max_file_bytes, F.concat(F.lit("File '"), "filename", F.lit(f"' is too large; limit is {max_file_bytes} bytes"))
    )
    rows = rows.withColumn("error", error)
    text = bytes_to_text(F.col("raw"))
    value = (
        F.when(F.col("route") == "text", text)
        .when(F.col("route") == "json", normalise_json(text))
        .when(F.col("route") == "fallback", T.strip(text))
    )
    return rows.select(
        "job_id",
        "pos",
        "filename",
        "mime",
        "role",
        F.when(F.col("error").isNull(), "processed").otherwise("failed").alias("status"),
        "error",
        "bytes",
        "route",
        F.when(F.col("error").isNull(), value).alias("text"),
    )


def role_texts(ingested: DataFrame, max_chars: int, files: DataFrame | None = None) -> DataFrame:
    """job_id, role (content or reference), text: headed file blocks in order, clipped to ``max_chars``.

    A block is cut to what the clip can hold before it moves, and keeps its full length; the running length decides which
    blocks can reach into the clip, and only those are gathered. ``files`` (job_id, role, pos) spares decoding payloads to
    sample a job's order.
    """
    block = F.concat(F.lit("\n\n### Source File: "), "filename", F.lit("\n"), T.strip(F.coalesce("text", F.lit(""))), F.lit("\n"))
    role = F.when(F.lower(T.strip(F.coalesce("role", F.lit("")))) == "reference", "reference").otherwise("content").alias("role")
    rows = ingested.filter(F.col("status") == "processed").select("job_id", role, "pos", block.alias("_block"))
    size, most = F.length("_block"), max_chars + 16
    # The mark behind a cut block lies beyond the clip; it keeps blanks before the cut from being stripped as the text's end.
    cut = F.concat(F.substring("_block", 1, most), F.when(size > most, "#").otherwise(""))
    rows = rows.select("job_id", "role", "pos", size.alias("_size"), cut.alias("_block"))
    like = None if files is None else files.select("job_id", role, "pos")
    rows = ordered(rows, ["job_id", "role"], ["pos"], sums={"_end": F.col("_size") + 1}, like=like)
    begin = F.col("_end") - F.col("_size") - 1
    # Eight more characters cover the stripped line feeds in front and the separators a dropped block would leave behind.
    near = rows.filter(begin < max_chars + 8)
    joined = near.groupBy("job_id", "role").agg(ordered_text(F.col("pos"), F.col("_block"), "\n").alias("text"))
    return joined.withColumn("text", F.substring(T.strip(F.col("text")), 1, max_chars))


def file_entries(ingested: DataFrame) -> DataFrame:
    """The summary's per-file list as rows: job_id, pos, filename, mime, role, status, bytes (processed) or error (failed)."""
    done = F.col("status") == "processed"
    return ingested.select("job_id", "pos", "filename", "mime", "role", "status", F.when(done, F.col("bytes")).alias("bytes"), "error")


def summary(ingested: DataFrame) -> DataFrame:
    """job_id, processed, failed, bytes. The per-file list is ``file_entries``, not a gathered array."""
    return ingested.groupBy("job_id").agg(
        F.count_if(F.col("status") == "processed").alias("processed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(F.col("status") == "processed", F.col("bytes"))), F.lit(0)).cast("bigint").alias("bytes"),
    )


def merge_content(typed: DataFrame, texts: DataFrame, max_chars: int) -> DataFrame:
    """job_id, content, reject: typed content followed by the uploaded text; empty or over-long rows carry a reason."""
    uploaded = texts.filter(F.col("role") == "content").select("job_id", F.col("text").alias("_up"))
    j = typed.join(uploaded, "job_id", "full_outer")
    base, up = F.coalesce("typed", F.lit("")), F.coalesce("_up", F.lit(""))
    content = F.when(up != "", F.concat(base, F.lit("\n\n"), up)).otherwise(base)
    j = j.select("job_id", content.alias("content"))
    reason = F.when(T.strip(F.col("content")) == "", "empty").when(F.length("content") > max_chars, "too_large")
    return j.withColumn("reject", reason)
