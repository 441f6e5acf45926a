"""Sharding along a Hilbert curve, in DataFrame operations only.

Metadata are quantised to a few bits each; a row's cell in that grid has an index on the
Hilbert curve, whose neighbours are neighbours in every dimension. Rows are put in the order
of the curve and the order is cut into runs, so a shard covers a compact region of all the
dimensions and a reader skips files by their minima and maxima.

Law ``rows``: shard counts differ by one at most. The place of a row needs no global sort: it
is the count of the rows in cells before its own, plus that of earlier blocks of ids in the
cell, plus its place in its own block. Only tables with a row for each cell (their number is
fixed by the bits) are put in one order; a cell that holds a third of all rows is spread over
its blocks of ids.

Null metadata are a value of their own, a null text has no bytes (size 1, checksum of the empty
string), a null id comes before all others. Rows of one id go by checksum and size; rows alike
in all of these are interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latewise.llm.common import staged

#: Ids of a block: the most rows with different ids that are ordered together in a cell.
BLOCK = 4096


def hilbert_index(cells: DataFrame, axes: list[str], bits: int, name: str = "curve") -> DataFrame:
    """``cells`` with the Hilbert index of integer columns ``axes`` (0 .. 2^bits - 1 each).

    The steps undo the rotations of each level, then take the Gray code, each step a projection
    of its own so that no expression grows."""
    x = [f"__h{i}" for i in range(len(axes))]
    df = cells.withColumns({c: F.col(a).cast("int") for c, a in zip(x, axes, strict=True)})
    for level in range(bits - 1, 0, -1):
        bit, low = F.lit(1 << level), F.lit((1 << level) - 1)
        for c in x:
            on = F.col(c).bitwiseAND(bit) != 0
            swap = F.col(x[0]).bitwiseXOR(F.col(c)).bitwiseAND(low)
            turned = {x[0]: F.when(on, F.col(x[0]).bitwiseXOR(low)).otherwise(F.col(x[0]).bitwiseXOR(swap))}
            if c != x[0]:
                turned[c] = F.when(on, F.col(c)).otherwise(F.col(c).bitwiseXOR(swap))
            df = df.withColumns(turned)
    for before, c in zip(x, x[1:], strict=False):
        df = df.withColumn(c, F.col(c).bitwiseXOR(F.col(before)))
    turn = F.lit(0)
    for level in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(F.lit(1 << level)) != 0, F.lit((1 << level) - 1)).otherwise(F.lit(0)))
    df = df.withColumn("__turn", turn).withColumns({c: F.col(c).bitwiseXOR(F.col("__turn")) for c in x})
    index = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for c in x:
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(F.col(c), level).bitwiseAND(F.lit(1)).cast("long"))
    return df.withColumn(name, index).drop("__turn", *x)


def shards(rows: DataFrame, axes: dict[str, Column], bits: int, n_shards: int, doc_id: str, tie: list[str]) -> DataFrame:
    """``rows`` with columns curve, shard and slot: cut along the curve over ``axes`` into
    ``n_shards`` runs with row counts at most one apart. ``rows`` is read several times, so it
    should be a stored table; ``doc_id`` is an integer."""
    names = list(axes)
    block = F.coalesce(F.floor(F.col(doc_id) / BLOCK), F.lit(-(1 << 62)))
    rows = rows.withColumns(axes).withColumn("__block", block)
    blocks = rows.groupBy(*names, "__block").agg(F.count("*").alias("__n"))
    cells = hilbert_index(blocks.groupBy(*names).agg(F.sum("__n").alias("__cell_n")), names, bits)
    # one row a cell: at most 2^(bits * axes) rows, whatever the input
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*names, "curve", F.coalesce(F.sum("__cell_n").over(along), F.lit(0)).alias("__before"),
                         F.sum("__cell_n").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"))
    inside = Window.partitionBy(*names).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (blocks.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
              .join(cells, names).select(*names, "__block", "curve", (F.col("__before") + F.col("__inside")).alias("__start"), "__all"))
    own = Window.partitionBy(*names, "__block").orderBy(F.col(doc_id).asc_nulls_first(), *tie)
    rank = F.col("__start") + F.row_number().over(own) - 1
    placed = rows.join(starts, [*names, "__block"]).withColumn("__rank", rank)
    shard = F.expr(f"__rank * {n_shards} div __all")
    first = F.expr(f"(shard * __all + {n_shards - 1}) div {n_shards}")
    return (placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("__rank") - first)
            .drop("__block", "__start", "__all", "__rank"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and one), text_crc32 and the grid of the curve:
    the magnitude of the size, language and source."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    hashed = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 15 + 1, F.lit(0)).cast("int")
    return docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.least(F.length(F.bin(size)) - 1, F.lit(15)).alias("__size"), hashed("lang").alias("__lang"), hashed("source").alias("__source"))


def op7_hilbert(spark, sf_dir: str) -> DataFrame:
    rows = staged(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "measured")
    placed = shards(rows, {c: F.col(c) for c in ("__lang", "__source", "__size")}, 4, 16, "doc_id", ["text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def _steps_sql(axes: list[str], bits: int) -> str:
    """The oracle's Hilbert index: nested selects, one for each step."""
    sql, rest = "cells", ", ".join(axes)
    x = [f"x{i}" for i in range(len(axes))]
    sql = f"SELECT {rest}, cell_n, " + ", ".join(f"{a}::INTEGER AS {c}" for a, c in zip(axes, x, strict=True)) + f" FROM {sql}"
    for level in range(bits - 1, 0, -1):
        for c in x:
            swap = f"(xor({x[0]}, {c}) & {(1 << level) - 1})"
            new = {d: d for d in x} | {c: f"CASE WHEN {c} & {1 << level} <> 0 THEN {c} ELSE xor({c}, {swap}) END"}
            new[x[0]] = f"CASE WHEN {c} & {1 << level} <> 0 THEN xor({x[0]}, {(1 << level) - 1}) ELSE xor({x[0]}, {swap}) END"
            sql = f"SELECT {rest}, cell_n, " + ", ".join(f"{e} AS {d}" for d, e in new.items()) + f" FROM ({sql})"
    for before, c in zip(x, x[1:], strict=False):
        sql = f"SELECT * REPLACE (xor({c}, {before}) AS {c}) FROM ({sql})"
    turn = "0"
    for level in range(bits - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN {x[-1]} & {1 << level} <> 0 THEN {(1 << level) - 1} ELSE 0 END)"
    sql = f"SELECT *, {turn} AS turn FROM ({sql})"
    index = " + ".join(f"(((xor({c}, turn) >> {level}) & 1)::BIGINT << {level * len(x) + len(x) - 1 - i})" for level in range(bits) for i, c in enumerate(x))
    return f"SELECT {rest}, cell_n, {index} AS curve FROM ({sql})"


def _crc_sql(value: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, byte by byte over a table made by the polynomial's rule."""
    octets = f"list_transform(regexp_extract_all(hex(encode({value})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"


_ENTRY = "i"
for _ in range(8):
    _ENTRY = f"list_transform([{_ENTRY}], lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)[1]"

OP7_SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: {_ENTRY}) AS crc_table),
measured AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {_crc_sql("coalesce(text, '')")} AS text_crc32,
    coalesce({_crc_sql('lang')} % 15 + 1, 0) AS a_lang, coalesce({_crc_sql('source')} % 15 + 1, 0) AS b_source,
    least(length(bin(strlen(coalesce(text, '')) + 1)) - 1, 15) AS c_size
  FROM documents, crc),
cells AS (SELECT a_lang, b_source, c_size, count(*) AS cell_n FROM measured GROUP BY ALL),
curve AS ({_steps_sql(["a_lang", "b_source", "c_size"], 4)}),
ranked AS (
  SELECT doc_id, size, text_crc32, curve, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, text_crc32, size) - 1 AS r, count(*) OVER () AS n
  FROM measured JOIN curve USING (a_lang, b_source, c_size)),
cut AS (SELECT *, (r * 16) // n AS shard FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY r) - 1 AS slot,
  NULL::INTEGER AS grown_shard, curve
FROM cut
"""
