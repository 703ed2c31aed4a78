"""Every query of the archive engine and its SQL.

Most pack a table into archives, read these as entries and compare what comes out with
the table: a codec or a header that is wrong changes the answer."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultframe.functions import checksums, codecs, filters, times
from vaultframe.functions.archives import archive_type, detected, directory_files, register_functions
from vaultframe.operators.build import build_archives
from vaultframe.plans import made
from vaultframe.operators.extract import extract, unsafe
from vaultframe.operators.inspect import first_in_folder, inspect
from vaultframe.operators.mutate import add, remove, replace
from vaultframe.sources.archive import explode_archives, read_archives, register
from vaultframe.sources.writers import WriteOptions
from vaultframe.streaming.landing import entries_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Documents of a language are dealt to so many archives at least, and to more where
#: these would hold more characters than PACK, so that none outgrows a binary cell.
DEAL, PACK = 16, 32 << 20


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.gettempdir()
    path = f"{root.removeprefix('file://').rstrip('/')}/vaultframe-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, path, True)
    return path


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: key lang/doc_id.txt, dealt to archives."""
    d = table(spark, sf_dir, "documents")
    deal = max(DEAL, -(-(d.agg(F.sum("n_chars")).first()[0] or 0) // PACK))
    return d.select(
        F.concat_ws("-", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(deal))).alias("pack"),
        F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("key"),
        F.encode(F.col("text"), "UTF-8").alias("content"),
    )


def packed_entries(files: DataFrame, kind, options: WriteOptions = WriteOptions(), **read: str) -> DataFrame:
    archives = build_archives(files, "pack", kind, options)
    return explode_archives(archives.select(F.col("pack").alias("path"), F.col("archive").alias("content")), **read)


DIGEST_SQL = "SELECT lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS key, CAST(octet_length(encode(text)) AS BIGINT) AS size, md5(text) AS content_md5 FROM documents"


def digest(entries: DataFrame) -> DataFrame:
    return entries.select("key", F.octet_length("content").cast("long").alias("size"), F.md5("content").alias("content_md5"))


@query("pack_scan_rollup", "SELECT lang, count(*) AS n_entries, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_size, true AS all_valid FROM documents GROUP BY lang")
def pack_scan_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = packed_entries(document_files(spark, sf_dir), "zip")
    return e.groupBy(F.split("key", "/")[0].alias("lang")).agg(F.count("*").alias("n_entries"), F.sum("size").alias("total_size"), F.bool_and("checksum_ok").alias("all_valid"))


def _round_trip(name: str, kind, options: WriteOptions = WriteOptions(), **read: str) -> None:
    @query(name, DIGEST_SQL)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return digest(packed_entries(document_files(spark, sf_dir), kind, options, **read))


for _codec in ("none", "deflate", "bzip2", "lzma", "zstd"):
    _round_trip(f"zip_{_codec}", "zip", WriteOptions(codec=_codec))
_round_trip("zip_zip64", "zip", WriteOptions(zip64=True))
_round_trip("zip_data_descriptors", "zip", WriteOptions(streaming=True), streaming="true")
_round_trip("zip_forward", "zip", WriteOptions(), streaming="true")
for _codec in ("none", "gzip", "bzip2", "lzip"):
    _round_trip(f"tar_{_codec}", "tar", WriteOptions(codec=_codec))
_round_trip("tar_ustar", "tar", WriteOptions(tar_format="ustar"))
for _codec in ("lzma", "lzma2"):
    _round_trip(f"sevenzip_{_codec}", "7z", WriteOptions(codec=_codec))
_round_trip("sevenzip_compressed_header", "7z", WriteOptions(compressed_header=True))


for _name, _pack in (("xz", made.xz), ("zstd", made.zstd), ("lzw", made.lzw)):
    _round_trip(f"tar_{_name}", made.tar_of(_pack))
_round_trip("tar_pax", made._pax)
for _name, _method, _flags in (("shrink", 1, 0), ("reduce1", 2, 0), ("reduce2", 3, 0), ("reduce3", 4, 0), ("reduce4", 5, 0), ("implode", 6, 0), ("deflate64", 9, 0), ("xz", 95, 0)):
    _round_trip(f"zip_{_name}", made.zip_by(_name, _method, _flags))
_round_trip("zip_pkware", made.zip_pkware, password=made.PASSWORD)
_round_trip("zip_aes", made.zip_aes, password=made.PASSWORD)
for _name, _make in made.SEVENZIP.items():
    _round_trip(f"sevenzip_{_name}", _make, password=made.PASSWORD)
for _name, _method, _pack in (("stored", 0, lambda x: x), ("best", 1, made.arj_best), ("fastest", 4, made.arj_fastest)):
    _round_trip(f"arj_{_name}", made.arj(_method, _pack))
_round_trip("ace_stored", made.ace)
_round_trip("rar4_stored", made.rar4())
_round_trip("rar4_encrypted", made.rar4(made.PASSWORD), password=made.PASSWORD)
_round_trip("rar5_stored", made.rar5(0))
_round_trip("rar5_packed", made.rar5(1))
_round_trip("rar5_encrypted", made.rar5(0, made.PASSWORD), password=made.PASSWORD)


def _arc_query(name: str, make) -> None:
    """Names of arc entries are short, so these are ids alone."""

    @query(name, DIGEST_SQL.replace("lang || '/' || ", "").replace("octet_length", "octet_length"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = document_files(spark, sf_dir).withColumn("key", F.split("key", "/")[1])
        return digest(packed_entries(files, make))


for _name, _method, _pack in (("stored", 2, lambda x: x), ("packed", 3, made.rle90), ("squeezed", 4, made.squeezed), ("crunched", 8, made.crunched)):
    _arc_query(f"arc_{_name}", made.arc(_method, _pack))


@query("lzw_single", "SELECT doc_id, md5(text) AS content_md5, 'Lzw' AS archive_type FROM documents")
def lzw_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), made_stream(F.encode("text", "UTF-8"), "lzw").alias("content"))
    return explode_archives(d).select(F.col("archive_path").cast("long").alias("doc_id"), F.md5("content").alias("content_md5"), "archive_type")


def made_stream(col, name: str):
    """A column of streams made for the queries."""

    @F.pandas_udf("binary")
    def run(s):
        return s.map(lambda x: made.STREAMS[name](bytes(x)))

    return run(col)


def _decode_query(name: str) -> None:
    @query(f"decode_{name}", "SELECT doc_id, md5(text) AS content_md5 FROM documents")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
        d = d.withColumn("packed", made_stream(F.col("raw"), name)).withColumn("out", codecs.decompress(F.col("packed"), name, F.octet_length("raw")))
        return d.select("doc_id", F.md5("out").alias("content_md5"))


for _name in ("adc", "rle90", "xz"):
    _decode_query(_name)


def _land(spark: SparkSession, rows: DataFrame, where: str) -> None:
    """Writes rows (name, content) as files below a folder that all executors share."""
    import os

    def put(batches):
        for b in batches:
            os.makedirs(where, exist_ok=True)
            for name, raw in zip(b["name"], b["content"], strict=True):
                with open(os.path.join(where, name), "wb") as f:
                    f.write(raw)
            yield b[["name"]]

    rows.select("name", "content").mapInPandas(put, "name string").count()


_NATIONS_SQL = "SELECT n_name AS key, md5(n_name) AS content_md5 FROM nation"


def _nation_packs(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("pack"), F.col("n_name").alias("key"), F.encode("n_name", "UTF-8").alias("content"))
    return build_archives(n, "pack", kind)


def _part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.pmod("p_partkey", F.lit(16)).alias("pack"), F.col("p_partkey").cast("string").alias("key"), F.encode("p_name", "UTF-8").alias("content"))


_PARTS_SQL = "SELECT CAST(p_partkey AS VARCHAR) AS key, CAST(octet_length(encode(p_name)) AS BIGINT) AS size, md5(p_name) AS content_md5 FROM part"


@query("sevenzip_ppmd", _PARTS_SQL)
def sevenzip_ppmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(packed_entries(_part_files(spark, sf_dir), made.ppmd))


@query("codec_ppmd", "SELECT p_partkey, md5(p_comment) AS content_md5 FROM (SELECT p_partkey, repeat(p_name, 20) AS p_comment FROM part)")
def codec_ppmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dealt(table(spark, sf_dir, "part").select("p_partkey", F.encode(F.repeat("p_name", 20), "UTF-8").alias("raw")))
    d = d.withColumn("out", codecs.decompress(codecs.compress(F.col("raw"), "ppmd"), "ppmd", F.octet_length("raw")))
    return d.select("p_partkey", F.md5("out").alias("content_md5"))


@query("split_volumes", _NATIONS_SQL)
def split_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives cut into .001, .002, .003, read through Spark's own source of files."""
    where = own_folder(spark)
    packs = _nation_packs(spark, sf_dir, "7z").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2))))
    third = F.ceil(F.octet_length("archive") / 3).cast("int")
    _land(spark, packs.select(F.concat("pack", F.lit(".7z.00"), (F.col("i") + 1).cast("string")).alias("name"), F.substring(F.col("archive"), F.col("i") * third + 1, third).alias("content")), where)
    return read_archives(spark, where).select("key", F.md5("content").alias("content_md5"))


@query("embedded_archives", _NATIONS_SQL)
def embedded_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives behind a program's bytes, as self-extracting ones are."""
    packs = _nation_packs(spark, sf_dir, "7z").select(F.col("pack").alias("path"), F.concat(F.lit(b"MZ" + bytes(3000)), F.col("archive")).alias("content"))
    return explode_archives(packs, lookForHeader="true").select("key", F.md5("content").alias("content_md5"))


@query("folder_as_input", _NATIONS_SQL)
def folder_as_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder packed and read again."""
    where = own_folder(spark)
    _land(spark, table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.encode("n_name", "UTF-8").alias("content")), where)
    files = directory_files(spark, where).withColumn("pack", F.lit("one"))
    return packed_entries(files, "zip").select("key", F.md5("content").alias("content_md5"))


@query("extracted_files", _NATIONS_SQL)
def extracted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written below a folder, and that folder read."""
    where = own_folder(spark)
    packs = _nation_packs(spark, sf_dir, "zip").select(F.col("pack").alias("path"), F.col("archive").alias("content"))
    extract(explode_archives(packs), where).count()
    return directory_files(spark, where).select("key", F.md5("content").alias("content_md5"))


@query("sink_appended_and_overwritten", "SELECT n_name AS key, count(*) AS n FROM nation, (VALUES (1), (2)) AS t(i) GROUP BY n_name")
def sink_appended_and_overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, overwritten by nations, to which these are appended again."""
    register(spark)
    where = own_folder(spark)
    put = lambda d, mode: d.write.format("archive").mode(mode).option("type", "zip").save(where)
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.encode("n_name", "UTF-8").alias("content"))
    put(table(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.encode("r_name", "UTF-8").alias("content")), "append")
    put(nations, "overwrite")
    put(nations, "append")
    return spark.read.format("archive").load(where).groupBy("key").agg(F.count("*").alias("n"))


@query("inspect_comments", "SELECT 'region' || CAST(n_regionkey AS VARCHAR) AS archive_path, 'from here' AS comment, 'Complete' AS status, '20' AS format_version, count(*) AS entry_count, CAST(sum(length(n_name)) AS BIGINT) AS uncompressed_payload_size, CAST(sum(length(n_name)) AS BIGINT) AS compressed_payload_size FROM nation GROUP BY n_regionkey")
def inspect_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("pack"), F.col("n_name").alias("key"), F.encode("n_name", "UTF-8").alias("content"))
    return inspect(packed_entries(n, "zip", WriteOptions(codec="none", comment="from here"))).select("archive_path", "comment", "status", "format_version", "entry_count", "uncompressed_payload_size", "compressed_payload_size")


@query("sevenzip_pack_sizes", "SELECT CAST(n_regionkey AS INTEGER) AS region, CAST(sum(length(n_name)) AS BIGINT) AS packed FROM nation GROUP BY n_regionkey")
def sevenzip_pack_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored 7z: what is packed is as large as the contents."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("pack"), F.col("n_name").alias("key"), F.encode("n_name", "UTF-8").alias("content"))
    return inspect(packed_entries(n, made.SEVENZIP["copy"])).select(F.col("archive_path").cast("int").alias("region"), F.col("compressed_payload_size").alias("packed"))


@query("gzip_single", "SELECT CAST(doc_id AS VARCHAR) || '.txt' AS key, CAST(octet_length(encode(text)) AS BIGINT) AS size, md5(text) AS content_md5, true AS checksum_ok FROM documents")
def gzip_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("pack"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("key"), F.encode("text", "UTF-8").alias("content"))
    e = packed_entries(d, "gzip")
    return e.select("key", "size", F.md5("content").alias("content_md5"), "checksum_ok")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly to all cores: a file of one row group is one task otherwise."""
    return rows.repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism))


def _codec_query(name: str) -> None:
    @query(f"codec_{name}", "SELECT doc_id, md5(text) AS content_md5, true AS changed FROM documents" if name != "none" else "SELECT doc_id, md5(text) AS content_md5, false AS changed FROM documents")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.encode("text", "UTF-8").alias("raw"))
        d = d.withColumn("packed", codecs.compress(F.col("raw"), name)).withColumn("out", codecs.decompress(F.col("packed"), name, F.octet_length("raw")))
        return d.select("doc_id", F.md5("out").alias("content_md5"), (F.col("packed") != F.col("raw")).alias("changed"))


for _codec in ("none", "deflate", "zlib", "gzip", "bzip2", "lzma", "lzma2", "lzip", "zstd"):
    _codec_query(_codec)


@query("codec_levels", "SELECT level, count(*) AS n, true AS all_equal FROM documents, (VALUES (0), (1), (6), (9)) AS l(level) GROUP BY level")
def codec_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.encode("text", "UTF-8").alias("raw"))
    parts = [d.select(F.lit(k).alias("level"), "raw", codecs.decompress(codecs.compress(F.col("raw"), "deflate", k), "deflate").alias("out")) for k in (0, 1, 6, 9)]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.groupBy("level").agg(F.count("*").alias("n"), F.bool_and(F.col("raw") == F.col("out")).alias("all_equal"))


def _filter_query(name: str) -> None:
    @query(f"filter_{name}", "SELECT page_id, md5(html) AS content_md5, CAST(octet_length(encode(html)) AS BIGINT) AS filtered_size FROM pages")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("raw"))
        p = p.withColumn("coded", filters.filtered(F.col("raw"), name, True, 4)).withColumn("out", filters.filtered(F.col("coded"), name, False, 4))
        return p.select("page_id", F.md5("out").alias("content_md5"), F.octet_length("coded").cast("long").alias("filtered_size"))


for _name in ("delta", "x86", "ppc", "ia64", "arm", "armt", "sparc", "arm64", "riscv"):
    _filter_query(_name)


def _crc_sql(poly: int, bits: int, start: int, final: int, kind: str) -> str:
    """A reflected CRC of p_name in SQL, by its byte table."""
    t = ", ".join(f"{x}::{kind}" for x in checksums._table(poly, (1 << bits) - 1))
    return f"""WITH t AS (SELECT [{t}] AS tab), b AS (SELECT p_partkey, list_transform(range(1, length(p_name) + 1), lambda i: CAST(ascii(substr(p_name, i, 1)) AS {kind})) AS bytes FROM part)
SELECT p_partkey, CAST(xor(list_reduce(bytes, lambda c, x: xor(tab[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8), {start}::{kind}), {final}::{kind}) AS {{out}}) AS checksum FROM b, t"""


def _high_table(poly: int) -> list[int]:
    """The byte table of a CRC-32 of the highest bit first."""
    out = []
    for n in range(256):
        n <<= 24
        for _ in range(8):
            n = ((n << 1) ^ poly if n & 0x80000000 else n << 1) & 0xFFFFFFFF
        out.append(n)
    return out


_CHECKS = {
    "crc64_iso": _crc_sql(0xD800000000000000, 64, 0, 0, "UBIGINT").format(out="VARCHAR"),
    "ace_header_crc": _crc_sql(0xEDB88320, 32, 0xFFFFFFFF, 0, "BIGINT").format(out="BIGINT").replace("AS checksum", "& 65535 AS checksum"),
    "bzip2_crc": _crc_sql(0xEDB88320, 32, 0xFFFFFFFF, 0xFFFFFFFF, "BIGINT").format(out="BIGINT").replace(", ".join(f"{x}::BIGINT" for x in checksums._table(0xEDB88320, 0xFFFFFFFF)), ", ".join(f"{x}::BIGINT" for x in _high_table(0x04C11DB7))).replace("tab[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8", "tab[CAST(xor(c >> 24, x) & 255 AS BIGINT) + 1], (c << 8) & 4294967295"),
    "crc32": _crc_sql(0xEDB88320, 32, 0xFFFFFFFF, 0xFFFFFFFF, "BIGINT").format(out="BIGINT"),
    "crc32_raw": _crc_sql(0xEDB88320, 32, 0xFFFFFFFF, 0, "BIGINT").format(out="BIGINT"),
    "crc16_arc": _crc_sql(0xA001, 16, 0, 0, "BIGINT").format(out="BIGINT"),
    "crc64_xz": _crc_sql(0xC96C5795D7870F42, 64, (1 << 64) - 1, (1 << 64) - 1, "UBIGINT").format(out="VARCHAR"),
    "adler32": "SELECT p_partkey, CAST((list_sum(list_transform(range(1, length(p_name) + 1), lambda i: (length(p_name) - i + 1) * ascii(substr(p_name, i, 1)))) + length(p_name)) % 65521 * 65536 + (1 + list_sum(list_transform(range(1, length(p_name) + 1), lambda i: ascii(substr(p_name, i, 1))))) % 65521 AS BIGINT) AS checksum FROM part",
}


def _checksum_query(name: str) -> None:
    @query(f"checksum_{name}", _CHECKS.get(name))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "part").select("p_partkey", checksums.checksum(F.encode("p_name", "UTF-8"), name).cast("string" if name.startswith("crc64") else "long").alias("checksum"))


for _name in ("crc32", "crc32_raw", "crc16_arc", "crc64_xz", "crc64_iso", "adler32", "ace_header_crc", "bzip2_crc"):
    _checksum_query(_name)


@query("digest_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def digest_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("digest_blake2sp")
def digest_blake2sp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", checksums.blake2sp_hex(F.encode("text", "UTF-8")).alias("digest"))


@query("entry_metadata", "SELECT lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS key, 'Zip' AS archive_type, 'Deflate' AS compression_type, CAST(octet_length(encode(text)) AS BIGINT) AS size, false AS is_directory, false AS is_encrypted, true AS is_complete FROM documents")
def entry_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = build_archives(document_files(spark, sf_dir), "pack")
    e = explode_archives(archives.select(F.col("pack").alias("path"), F.col("archive").alias("content")), content=False)
    return e.select("key", "archive_type", "compression_type", "size", "is_directory", "is_encrypted", "is_complete")


@query("inspect_archives", f"""WITH d AS (SELECT lang, octet_length(encode(text)) AS n FROM documents)
SELECT lang, 'Zip' AS container_type, CAST(count(*) AS BIGINT) AS entry_count, CAST(sum(n) AS BIGINT) AS uncompressed_payload_size, CAST(0 AS BIGINT) AS entries_with_unknown_size, false AS is_solid, false AS is_encrypted, true AS is_complete FROM d GROUP BY lang -- {DEAL}""")
def inspect_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = inspect(packed_entries(document_files(spark, sf_dir), "zip"))
    return one.groupBy(F.split("archive_path", "-")[0].alias("lang")).agg(
        F.first("container_type").alias("container_type"), F.sum("entry_count").alias("entry_count"), F.sum("uncompressed_payload_size").alias("uncompressed_payload_size"), F.sum("entries_with_unknown_size").alias("entries_with_unknown_size"),
        F.bool_or("is_solid").alias("is_solid"), F.bool_or("is_encrypted").alias("is_encrypted"), F.bool_and("is_complete").alias("is_complete"),
    )


def _order_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as if they were entries, for the roll-ups."""
    return table(spark, sf_dir, "orders").select(
        F.concat("o_orderpriority", "o_orderstatus").alias("archive_path"), F.col("o_orderkey").alias("entry_index"),
        F.floor("o_totalprice").cast("long").alias("size"), F.lit(0).cast("long").alias("compressed_size"), (F.col("o_totalprice") > 100000).alias("is_solid"), F.lit(False).alias("is_directory"), F.lit(False).alias("is_encrypted"), F.lit(True).alias("is_complete"),
        F.lit("SevenZip").alias("archive_type"), F.lit("None").alias("outer_compression"), F.lit(0).alias("volume_index_last"), F.pmod("o_custkey", F.lit(50)).cast("int").alias("folder"),
    )


_ORDERS = "SELECT o_orderpriority || o_orderstatus AS archive_path, o_orderkey AS entry_index, CAST(floor(o_totalprice) AS BIGINT) AS size, o_totalprice > 100000 AS is_solid, CAST(o_custkey % 50 AS INTEGER) AS folder FROM orders"


@query("solid_runs", f"WITH e AS ({_ORDERS}), w AS (SELECT *, is_solid AND NOT coalesce(lag(is_solid) OVER (PARTITION BY archive_path ORDER BY entry_index), false) AS start FROM e) SELECT archive_path, count(*) AS entry_count, CAST(sum(size) AS BIGINT) AS uncompressed_payload_size, CAST(sum(CASE WHEN start THEN 1 ELSE 0 END) AS BIGINT) AS solid_stream_count, bool_or(is_solid) AS is_solid FROM w GROUP BY archive_path")
def solid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect(_order_entries(spark, sf_dir)).select("archive_path", "entry_count", "uncompressed_payload_size", "solid_stream_count", "is_solid")


@query("solid_by_folder", f"WITH e AS ({_ORDERS}), w AS (SELECT archive_path, folder, row_number() OVER (PARTITION BY archive_path, folder ORDER BY entry_index) > 1 AS s FROM e) SELECT archive_path, folder, count(*) AS entries, CAST(sum(CASE WHEN s THEN 1 ELSE 0 END) AS BIGINT) AS solid_entries FROM w GROUP BY archive_path, folder HAVING count(*) > 1")
def solid_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = first_in_folder(_order_entries(spark, sf_dir))
    return marked.groupBy("archive_path", "folder").agg(F.count("*").alias("entries"), F.sum(F.col("is_solid").cast("long")).alias("solid_entries")).filter("entries > 1")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("archive_path"), F.col("doc_id").alias("entry_index"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("key"), F.col("n_chars").alias("size"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.lit("en").alias("archive_path"), F.concat(F.lit("/nation/"), F.col("n_name")).alias("key"), F.length("n_name").cast("long").alias("size"))


@query("remove_entries", "SELECT lang AS archive_path, doc_id AS entry_index, 'doc/' || CAST(doc_id AS VARCHAR) AS key, n_chars AS size FROM documents WHERE n_chars < 5000")
def remove_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _keys(spark, sf_dir)
    return remove(e, e.filter("size >= 5000"))


@query("add_entries", "WITH m AS (SELECT max(doc_id) + 1 AS b FROM documents WHERE lang = 'en') SELECT lang AS archive_path, doc_id AS entry_index, 'doc/' || CAST(doc_id AS VARCHAR) AS key, n_chars AS size FROM documents UNION ALL SELECT 'en', b + row_number() OVER (ORDER BY '/nation/' || n_name) - 1, 'nation/' || n_name, CAST(length(n_name) AS BIGINT) FROM nation, m")
def add_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add(_keys(spark, sf_dir), _nations(spark, sf_dir))


@query("replace_entries", "SELECT lang AS archive_path, 'doc/' || CAST(doc_id AS VARCHAR) AS key, CASE WHEN quality IS NULL THEN n_chars ELSE -1 END AS size FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)")
def replace_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality is not null")
    new = table(spark, sf_dir, "documents").join(labels, "doc_id").select(F.col("lang").alias("archive_path"), F.concat(F.lit("DOC\\"), F.col("doc_id").cast("string")).alias("key"), F.lit(-1).cast("long").alias("size"))
    out = replace(_keys(spark, sf_dir), new)
    return out.select("archive_path", F.lower(F.translate("key", "\\", "/")).alias("key"), "size")


@query("dos_times", "SELECT event_id, CAST((year(ts) - 1980) * 33554432 + month(ts) * 2097152 + day(ts) * 65536 + hour(ts) * 2048 + minute(ts) * 32 + CAST(floor(second(ts) / 2) AS BIGINT) AS BIGINT) AS dos, strftime(date_trunc('minute', ts) + to_seconds(CAST(2 * floor(second(ts) / 2) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS back FROM events")
def dos_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", times.to_dos_col(F.col("ts").cast("timestamp_ntz")).alias("dos"))
    return e.select("event_id", "dos", F.date_format(times.dos_time_col(F.col("dos")), "yyyy-MM-dd HH:mm:ss").alias("back"))


@query("tar_names", r"SELECT page_id, trim(regexp_replace(replace(url, '\', '/'), '^[^:]*:', ''), '/') AS name FROM pages")
def tar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", times.tar_name_col(F.col("url")).alias("name"))


@query("octal_numbers", "SELECT p_partkey, CAST(p_size AS BIGINT) AS value FROM part")
def octal_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lpad(F.conv(F.col("p_size").cast("string"), 10, 8), 11, "0"), F.lit("\0"))
    return table(spark, sf_dir, "part").select("p_partkey", times.octal_col(text).alias("value"))


@query("unsafe_keys", "SELECT 'up' AS archive_path, '../' || n_name AS key FROM nation UNION ALL SELECT 'root', '/' || n_name FROM nation UNION ALL SELECT 'drive', 'C:' || chr(92) || n_name FROM nation")
def unsafe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    make = lambda a, *k: n.select(F.lit(a).alias("archive_path"), F.concat(*k).alias("key"))
    every = make("up", F.lit("../"), "n_name").union(make("root", F.lit("/"), "n_name")).union(make("drive", F.lit("C:\\"), "n_name")).union(make("fine", F.lit("a/"), "n_name", F.lit("/..x")))
    return unsafe(every)


def _each_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_name", F.col("n_name").alias("key"), F.encode("n_name", "UTF-8").alias("content"))
    made = {"zip": ("zip", None), "tar": ("tar", None), "tar.gz": ("tar", "gzip"), "tar.bz2": ("tar", "bzip2"), "tar.lz": ("tar", "lzip"), "7z": ("7z", None)}
    # A gzip holds one file, so every nation has its own.
    out = build_archives(n.withColumn("pack", F.col("n_name")), "pack", "gzip").withColumn("pack", F.lit("gzip"))
    for name, (kind, codec) in made.items():
        out = out.union(build_archives(n.withColumn("pack", F.lit(name)), "pack", kind, WriteOptions(codec=codec)))
    return out


@query("detect_formats", "SELECT * FROM (VALUES ('7z', 'SevenZip', 'None'), ('gzip', 'GZip', 'None'), ('tar', 'Tar', 'None'), ('tar.bz2', 'Tar', 'BZip2'), ('tar.gz', 'Tar', 'GZip'), ('tar.lz', 'Tar', 'LZip'), ('zip', 'Zip', 'None')) AS t(made, archive_type, outer_compression)")
def detect_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = explode_archives(_each_format(spark, sf_dir).select(F.col("pack").alias("path"), F.col("archive").alias("content")), content=False)
    return e.select(F.col("archive_path").alias("made"), "archive_type", "outer_compression").distinct()


@query("archive_type_column", ORACLE_SQL["detect_formats"].replace("SELECT * FROM", "SELECT made, archive_type, true AS agrees FROM"))
def archive_type_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _each_format(spark, sf_dir).select(F.col("pack").alias("made"), "archive")
    return made.select("made", archive_type(F.col("archive")).alias("archive_type"), (archive_type(F.col("archive")) == detected(F.col("archive")).archive_type).alias("agrees")).distinct()


@query("entries_table_function", "SELECT n_name AS key, CAST(length(n_name) AS BIGINT) AS size, md5(n_name) AS content_md5 FROM nation")
def entries_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_functions(spark)
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("pack"), F.col("n_name").alias("key"), F.encode("n_name", "UTF-8").alias("content"))
    name = f"made_{uuid.uuid4().hex}"
    build_archives(n, "pack", "7z").createOrReplaceTempView(name)
    return spark.sql(f"SELECT e.key, e.size, md5(e.content) AS content_md5 FROM {name} m, LATERAL archive_entries(m.archive) e")


@query("sink_and_source", DIGEST_SQL)
def sink_and_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    where = own_folder(spark)
    files = document_files(spark, sf_dir)
    files.repartition(8, "pack").sortWithinPartitions("pack", "key").select("key", "content").write.format("archive").mode("append").option("type", "zip").save(where)
    return digest(spark.read.format("archive").load(where))


@query("source_by_key", "SELECT lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS key, CAST(octet_length(encode(text)) AS BIGINT) AS size, md5(text) AS content_md5 FROM documents WHERE lang = 'fr'")
def source_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    where = own_folder(spark)
    files = document_files(spark, sf_dir)
    files.repartition(8, "pack").sortWithinPartitions("pack", "key").select("key", "content").write.format("archive").mode("append").option("type", "tar").option("codec", "gzip").save(where)
    return digest(spark.read.format("archive").option("keyGlob", "fr/*").load(where))


@query("landing_stream", ORACLE_SQL["pack_scan_rollup"])
def landing_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    where, name = own_folder(spark), f"landed_{uuid.uuid4().hex}"
    document_files(spark, sf_dir).repartition(8, "pack").sortWithinPartitions("pack", "key").select("key", "content").write.format("archive").mode("append").option("type", "zip").save(where)
    e = entries_stream(spark, where, glob="*.zip")
    agg = e.groupBy(F.split("key", "/")[0].alias("lang")).agg(F.count("*").alias("n_entries"), F.sum("size").alias("total_size"), F.bool_and("checksum_ok").alias("all_valid"))
    q = agg.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", own_folder(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
