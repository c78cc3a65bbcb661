"""Minimax contiguous partition of documents into shards, with DataFrame functions only.

Groups of equal texts are atomic. They are ordered by a hash of the text, and the 65,536 cells of that order (all texts
whose md5 has the same first 16 bits) are the units that get cut, so what is searched has a fixed size however large the
corpus is. A binary search finds the smallest capacity that lets a greedy walk over the ordered sizes end within the
number of shards. A second search, under that capacity, finds the smallest fill at which a shard may be closed without
needing one shard more: it evens out the shards that a plain greedy walk would leave nearly empty at the end.

Positions in a shard need no sort of a whole shard: rows are numbered within small pieces (cell, 1 of 256 salts of
doc_id), and each piece starts where the counts before it end. A text that a third of all rows share falls into 256 pieces.

Defined cases: null text counts as empty (size 1, CRC 0) and joins the group of empty texts; rows repeated with the same
doc_id are rows of their own; very long texts count by their bytes; null doc_id is a row like any other (first among ties); an empty table gives no rows; fewer
groups than shards leave shards empty; extra columns are ignored. One group larger than the fair share makes its shard
that large: groups are never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import shared_dir, table

CELL_HEX = 4  # 16 bits: 65,536 cells
SALTS = 256

#: Greedy walk over the ordered sizes: a shard is closed when the next size would exceed `cap` or when it has reached `enough`.
_WALK = """aggregate(sizes, named_struct('n', 1L, 'fill', 0L),
    (a, x) -> if(a.fill > 0 and (a.fill + x > {cap} or a.fill >= {enough}),
                 named_struct('n', a.n + 1L, 'fill', x), named_struct('n', a.n, 'fill', a.fill + x)), a -> a.n)"""

#: Binary search for the smallest value in [lo, hi] that passes `test` (of `s.mid`); 62 halvings cover any 64-bit range.
_SEARCH = """aggregate(sequence(1, 62), named_struct('lo', {lo}, 'hi', {hi}, 'mid', ({lo} + {hi}) div 2),
    (s, i) -> if(s.lo >= s.hi, s, if({test} <= {shards},
        named_struct('lo', s.lo, 'hi', s.mid, 'mid', (s.lo + s.mid) div 2),
        named_struct('lo', s.mid + 1L, 'hi', s.hi, 'mid', (s.mid + 1L + s.hi) div 2))), s -> s.hi)"""


def cut_cells(cells: DataFrame, shards: int) -> DataFrame:
    """cells(cell int, bytes long) with a row for each cell -> (cell, shard): contiguous, the largest shard minimal.

    What comes back to the driver is the two searched numbers and the first cell of each shard.
    """
    one = cells.agg(F.sort_array(F.collect_list(F.struct("cell", "bytes"))).alias("cells")).where(F.size("cells") > 0)
    one = one.withColumn("sizes", F.expr("transform(cells, c -> c.bytes)"))
    capacity = _SEARCH.format(lo="array_max(sizes)", hi="aggregate(sizes, 0L, (a, x) -> a + x)", shards=shards, test=_WALK.format(cap="s.mid", enough="s.mid"))
    found = one.select(F.expr(capacity)).first()
    if found is None:
        return cells.select("cell", F.lit(0).alias("shard"))
    cap = f"{found[0]}L"
    enough = f"{one.select(F.expr(_SEARCH.format(lo='1L', hi=cap, shards=shards, test=_WALK.format(cap=cap, enough='s.mid')))).first()[0]}L"
    starts = one.select(F.expr(f"""aggregate(cells, named_struct('starts', array(cells[0].cell), 'fill', 0L),
        (a, c) -> if(a.fill > 0 and (a.fill + c.bytes > {cap} or a.fill >= {enough}),
                     named_struct('starts', concat(a.starts, array(c.cell)), 'fill', c.bytes),
                     named_struct('starts', a.starts, 'fill', a.fill + c.bytes)), a -> a.starts)""")).first()[0]
    number = F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= F.col("cell"))) - 1
    return cells.select("cell", number.cast("int").alias("shard"))


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, cell, shard, slot: near-equal bytes, equal texts together."""
    shared_dir(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, CELL_HEX), 16, 10).cast("int").alias("cell"),
        F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)), F.lit(0)).cast("int").alias("salt"),
    )
    pieces = rows.groupBy("cell", "salt").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    cells = pieces.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).checkpoint()
    cut = cut_cells(cells.select("cell", "bytes"), shards)
    in_shard = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.join(cut, "cell").select("cell", "shard", F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("cell_at"))
    in_cell = Window.partitionBy("cell").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    at = pieces.select("cell", "salt", F.coalesce(F.sum("n").over(in_cell), F.lit(0)).alias("piece_at")).join(placed, "cell")
    number = F.row_number().over(Window.partitionBy("cell", "salt").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("number", number)
        .join(at, ["cell", "salt"])
        .select("doc_id", "size", "text_crc32", "cell", "shard", (F.col("cell_at") + F.col("piece_at") + F.col("number") - 1).alias("slot"))
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law `bytes`."""
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLES: dict[str, str] = {}
