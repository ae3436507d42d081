"""Line deduplication (native).

Lines' 128-bit key hashes are dealt to fixed ranges (hashes are uniform, so nothing is sampled) and sorted by document and
position; a running window streams each key's first occurrence, and what comes back to the documents is a compressed bitmap of
dropped lines, never text.  A hot key cannot fill a task: a first level works on (hash, salt of the document), and only the first
document of each salt goes on to the second level, which drops what another salt's document precedes.  There are two salts a
shuffle partition, so they grow with the job.

Bitmaps are written, and joined to the documents by broadcast up to BITMAP_WORDS words of them; beyond, by a shuffle.

Defined cases: null or empty text is one empty line; rows with one doc_id are one document (each
row keeps its own bitmap); a null doc_id counts as the largest id; equal lines of the first document all stay; extra columns are
ignored by :func:`line_bitmaps` and kept by :func:`dedup_lines`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, fresh, lower_ascii, tasks, text_hash, written

LEAST_SALTS, BITMAP_WORDS = 64, 1_000_000
LAST = (1 << 63) - 1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _dropped(docs: DataFrame, min_chars: int) -> DataFrame:
    """(_id, _th, pos) of every line that goes."""
    parts = tasks(docs.sparkSession)
    lines = (
        docs.select(
            F.coalesce("doc_id", F.lit(LAST)).alias("_id"),
            text_hash(F.col("text")).alias("_th"),
            _lines(lower_ascii(F.col("text"))).alias("lines"),
        )
        .select("_id", "_th", F.posexplode("lines").alias("pos", "line"))
        .withColumn("line", F.btrim("line", F.lit(SPACES)))
        .where(F.length("line") >= min_chars)
        .select(
            F.xxhash64("line").alias("h1"),
            F.xxhash64(F.lit(7), "line").alias("h2"),
            F.pmod(F.xxhash64("_id"), F.lit(max(LEAST_SALTS, 2 * parts))).cast("int").alias("salt"),
            "_id",
            "_th",
            "pos",
        )
    )
    # The upper 31 bits of a hash of key and salt, cut into as many equal ranges as there are tasks.
    place = F.shiftrightunsigned(F.xxhash64("h1", "h2", "salt"), 33)
    ranged = lines.withColumn("range", F.shiftright(place * parts, 31).cast("int"))
    ranged = ranged.repartitionById(parts, F.col("range"))
    near = Window.partitionBy("range", "h1", "h2", "salt").orderBy("_id", "pos")
    level1 = ranged.withColumn("first", F.first("_id").over(near))
    # Carries both kinds of row through one plan: a row that is no first of its salt needs no second look.
    salted = Window.partitionBy("h1", "h2", "_part").orderBy("_id", "pos")
    level2 = (
        level1.withColumn("_part", F.when(F.col("_id") == F.col("first"), F.lit(-1)).otherwise(F.col("salt")))
        .withColumn("first2", F.first("_id").over(salted))
        .where((F.col("_id") > F.col("first")) | (F.col("_id") > F.col("first2")))
    )
    return level2.select("_id", "_th", "pos")


def line_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(_id, _th, n_dropped, bits): bits is the sparse bitmap of dropped lines as (word, 64 bits) sorted by word.

    Documents without dropped lines have no row.  _id is doc_id (null: the largest long) and _th the text's hash.
    """
    words = (
        _dropped(docs, min_chars)
        .groupBy("_id", "_th", F.shiftright("pos", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, pos & 63))").alias("bits"))
    )
    return words.groupBy("_id", "_th").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("bits"),
    )


def _positions(bits: Column) -> Column:
    """The set bits of a sparse bitmap as sorted positions."""
    one = lambda w: F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.getbit(w["bits"], b) == 1, w["word"] * 64 + b)),
        lambda p: p.isNotNull(),
    )
    return F.flatten(F.transform(bits, one))


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """docs with text replaced by its kept lines (null becomes empty), plus n_lines and n_dropped in place of columns so named.

    A line whose trimmed, A-Z lower-cased form has min_chars code points or more and stands in two
    documents or more stays only in the smallest doc_id that holds it, there with all its repeats.
    """
    id_, th, bid, bth, bn, bits, ls = fresh(docs, "_id", "_th", "_bid", "_bth", "_bn", "_bits", "_lines")
    maps = line_bitmaps(docs, min_chars).select(
        F.col("_id").alias(bid), F.col("_th").alias(bth), F.col("n_dropped").alias(bn), F.col("bits").alias(bits)
    )
    maps = written(maps, "bitmaps")
    size = maps.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size(bits)), F.lit(0))).first()[0]
    maps = F.broadcast(maps) if size <= BITMAP_WORDS else maps.hint("shuffle_hash")
    left = docs.withColumn(id_, F.coalesce("doc_id", F.lit(LAST))).withColumn(th, text_hash(F.col("text")))
    joined = left.join(maps, (F.col(id_) == F.col(bid)) & (F.col(th) == F.col(bth)), "left")
    lines = _lines(F.col("text"))
    all_pos = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.transform(F.array_except(all_pos, _positions(F.col(bits))), lambda i: F.get(F.col(ls), i))
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    text = F.when(F.col(bits).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(ls, lines).select(
        *[text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in own],
        F.size(ls).cast("long").alias("n_lines"),
        F.coalesce(bn, F.lit(0)).cast("long").alias("n_dropped"),
    )


def op3(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key
), m AS (
  SELECT k.*, (f.first IS NULL OR k.doc_id = f.first) AS keep FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
