"""Pages and documents in, JSON and index tables out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGES = T.StructType([T.StructField("url", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("metadata", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])
DOCUMENT = T.StructType([T.StructField(c, T.StringType()) for c in ("author", "text", "date_post", "url", "site_name", "real_doc", "date_retr")] + [T.StructField("is_search", T.BooleanType()), T.StructField("tags", T.ArrayType(T.StringType()))])
CHARSETS = {"utf-8": "UTF-8", "iso-8859-1": "ISO-8859-1", "us-ascii": "US-ASCII", "utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE", "latin1": "ISO-8859-1"}
SUFFIX_TYPES = {"i": "int", "l": "long", "f": "float", "d": "double", "b": "boolean", "s": "string", "dt": "timestamp"}


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False, schema: T.StructType = PAGES) -> DataFrame:
    return (spark.readStream if streaming else spark.read).format(fmt).schema(schema).load(path)


# Charsets of one byte a character that are told from bytes; any other that Python knows works where it is named.
SINGLE = ("windows-1252", "iso-8859-2", "windows-1251", "koi8-r", "iso-8859-7")
NAMED = (*SINGLE, "windows-1250", "windows-1253", "windows-1254", "windows-1257", "iso-8859-5", "iso-8859-9", "iso-8859-15", "koi8-u", "macintosh")
HIGH = "".join(map(chr, range(128, 256)))
# The sequences of UTF-8, as characters of ISO-8859-1.
UTF8 = r"[\x00-\x7F]+|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"
# What speaks for a charset when bytes are read in it, and what against it: letters of its languages and pairs of them;
# signs within words, changes from small to capital letters, runs of letters with marks, a final sigma within a word.
FOR = {
    "windows-1252": ("[a-zA-Z][éèàçêñãõäöüßåøæâîôûëïíóúá]|[éèàçêñãõäöüßåøæâîôûëïíóúáÉÄÖÜÅØ][a-z]", r"[a-z][^\x00-\x7Fà-öø-ÿß][a-z]?|[à-öø-ÿ]{3}"), "iso-8859-2": ("[a-zA-Z][łąężśćńźčšžřěůťďňőűóáíéýúöü]|[łąężśćńźčšžřěůťďňőűŁŚŻČŠŽŘ][a-z]", r"[a-z][ŕĺľ¤¨´˝˘§]|[aeiou]ń[aeiou]|[\x80-\x9F]|[^\x00-\x7F]{3}"),
    "windows-1251": ("[а-яё][а-яё]", "[а-яё][А-ЯЁ]|[а-яё][^\\x00-\\x7Fа-яёА-ЯЁ]"), "koi8-r": ("[а-яё][а-яё]", "[а-яё][А-ЯЁ]|[а-яё][^\\x00-\\x7Fа-яёА-ЯЁ]"), "iso-8859-7": ("[α-ωά-ώ][α-ωά-ώ]", r"ς[α-ωά-ώ]|[α-ωά-ώ][Α-Ω]|[α-ωά-ώ][^\x00-\x7Fα-ωά-ώΑ-Ω]"),
}


def in_charset(latin: Column, name: str) -> Column:
    """Text in a charset of one byte a character, from its bytes read as ISO-8859-1."""
    signs = "".join(bytes([b]).decode(name, "replace") for b in range(128, 256))
    return F.translate(latin, HIGH, signs)


def charset_of(content: Column, most: int = 2048) -> Column:
    """The charset that the first bytes speak for: UTF-16 by its mark or its zeros, UTF-8 if they are valid in it (a last
    sequence that is cut off does not count), else that of SINGLE with the best score, the first of equals."""
    head = F.decode(F.substring(content, 1, most), "ISO-8859-1")
    whole = F.regexp_replace(head, r"[\xC0-\xFF][\x80-\xBF]{0,2}$", "")
    best = None
    for name in SINGLE:
        good, bad = FOR[name]
        text = in_charset(head, name)
        score = F.regexp_count(text, F.lit(good)) - 3 * F.regexp_count(text, F.lit(bad))
        best = F.struct(score.alias("s"), F.lit(-SINGLE.index(name)).alias("k"), F.lit(name).alias("name")) if best is None else F.greatest(best, F.struct(score.alias("s"), F.lit(-SINGLE.index(name)).alias("k"), F.lit(name).alias("name")))
    found = F.when(head.startswith("\xff\xfe"), "utf-16le").when(head.startswith("\xfe\xff"), "utf-16be").when(head.rlike(r"(?s)^([^\x00]\x00){4}"), "utf-16le").when(head.rlike(r"(?s)^(\x00[^\x00]){4}"), "utf-16be")
    return found.when(F.regexp_replace(whole, UTF8, "") == "", "utf-8").otherwise(best["name"])


def decode_content(df: DataFrame, content: str = "content", header: str | None = None) -> DataFrame:
    """Adds charset and text. The charset is the header's, else the one named in the first 2048 bytes, else the one that
    those bytes speak for. What a charset has no character for becomes U+FFFD; an unknown charset is read as UTF-8."""
    head = F.decode(F.substring(F.col(content), 1, 2048), "ISO-8859-1")
    named = lambda c: F.lower(F.regexp_extract(c, r"(?i)charset=[\"']?([A-Za-z0-9_-]+)", 1))
    found = F.coalesce(F.nullif(named(F.col(header)), F.lit("")) if header else F.lit(None), F.nullif(named(head), F.lit("")), charset_of(F.col(content)))
    latin, text = F.decode(F.col(content), "ISO-8859-1"), F.decode(F.col(content), "UTF-8")
    for name, java in CHARSETS.items():
        text = F.when(F.col("charset") == name, F.decode(F.col(content), java)).otherwise(text)
    for name in NAMED:
        text = F.when(F.col("charset") == name, in_charset(latin, name)).otherwise(text)
    return df.withColumn("charset", found).withColumn("text", F.regexp_replace(text, "^\ufeff", ""))


def mime_type(header: Column, url: Column, content: Column) -> Column:
    """From the header, else the address, else how the content begins."""
    start = F.lower(F.trim(F.substring(content, 1, 200)))
    return (
        F.when(header.isNotNull() & (header != ""), F.lower(F.trim(F.split(header, ";")[0]))).when(url.rlike(r"(?i)\.(html?|php|aspx?)$"), "text/html").when(url.rlike(r"(?i)\.json$"), "application/json")
        .when(url.rlike(r"(?i)\.pdf$") | start.startswith("%pdf"), "application/pdf").when(start.startswith("<!doctype html") | start.startswith("<html"), "text/html").when(start.startswith("<?xml"), "application/xml").otherwise("text/plain")
    )


def read_json_docs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).json(path)


def docs_to_json(df: DataFrame, keys: list[str], columns: list[str], part: Column | None = None) -> DataFrame:
    """The documents of each key as JSON lists; [] where there are none. `part` splits the documents of a key in lists of
    their own, so that a hot key is neither one task nor one row."""
    by = [*keys] if part is None else [*keys, part.alias("part")]
    return df.groupBy(*by).agg(F.to_json(F.coalesce(F.array_sort(F.collect_list(F.struct(*columns))), F.array())).alias("docs"))


def upsert(index: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each key; an update wins a tie."""
    rows = index.withColumn("_u", F.lit(0)).unionByName(updates.withColumn("_u", F.lit(1)))
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), F.desc("_u")))
    return rows.withColumn("_k", k).filter("_k = 1").drop("_k", "_u")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below spark.checkpoint.dir, which all executors share; a local one only where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='lexloom-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back, so that what follows does not compute it again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_version(df: DataFrame, folder: str) -> str:
    """Writes a table in a folder of its own and returns it: readers of the last version are not disturbed."""
    path = f"{folder}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def delete_where(index: DataFrame, predicate: Column) -> DataFrame:
    return index.filter(~F.coalesce(predicate, F.lit(False)))


def blocklist(lines: DataFrame, present: DataFrame) -> DataFrame:
    """New addresses from lines: blank ones and comments skipped; a single word is the address, else the second one."""
    line = F.trim("value")
    parts = F.split(line, r"\s+")
    rows = lines.filter((line != "") & ~line.startswith("#")).select(F.when(F.size(parts) == 1, parts[0]).otherwise(F.get(parts, F.lit(1))).alias("address"))
    return rows.dropDuplicates().join(present, "address", "left_anti")


def cast_by_suffix(df: DataFrame) -> DataFrame:
    """Columns typed by the end of their names; a plural suffix (_is, _fs ...) makes an array of the type."""

    def typed(name: str) -> Column:
        end = name.rpartition("_")[2] if "_" in name else ""
        if end in SUFFIX_TYPES:
            return F.col(name).try_cast(SUFFIX_TYPES[end]).alias(name)
        if end[:-1] in SUFFIX_TYPES and end.endswith("s"):
            return F.col(name).try_cast(f"array<{SUFFIX_TYPES[end[:-1]]}>").alias(name)
        return F.col(name)

    return df.select(*[typed(c) for c in df.columns])
