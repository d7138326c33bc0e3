"""Sharding along a Hilbert curve, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import release, saved


def hilbert_index(codes: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of a cell, given by one code from 0 to 2^bits - 1 for each dimension.

    Works down from the highest bit. At each level the bits of all dimensions name a subcube; turned by the
    current entry corner and direction, its inverse Gray code is the next digit of the index, and decides
    the corner and direction of the level below.
    """
    n = len(codes)
    size, mask = 1 << n, (1 << n) - 1
    gray = [w ^ (w >> 1) for w in range(size)]
    digit = F.array(*[F.lit(gray.index(g)) for g in range(size)])
    corner = F.array(*[F.lit(0 if w == 0 else gray[2 * ((w - 1) // 2)]) for w in range(size)])
    ones = lambda x: (~x & (x + 1)).bit_length() - 1  # noqa: E731  trailing ones
    turn = F.array(*[F.lit(0 if w == 0 else (ones(w - 1) if w % 2 == 0 else ones(w)) % n) for w in range(size)])
    left = lambda x, k: F.call_function("shiftleft", x, k).bitwiseOR(F.call_function("shiftright", x, n - k)).bitwiseAND(F.lit(mask))
    right = lambda x, k: F.call_function("shiftright", x, k).bitwiseOR(F.call_function("shiftleft", x, n - k)).bitwiseAND(F.lit(mask))

    def level(state: Column, bit: Column) -> Column:
        cube = F.lit(0)
        for i, code in enumerate(codes):
            cube = cube.bitwiseOR(F.shiftleft(F.call_function("shiftright", code.cast("int"), bit).bitwiseAND(F.lit(1)), i))
        shift = (state["turn"] + 1) % n
        w = F.element_at(digit, right(cube.bitwiseXOR(state["corner"]), shift) + 1)
        return F.struct(
            F.shiftleft(state["h"], n).bitwiseOR(w.cast("long")).alias("h"),
            state["corner"].bitwiseXOR(left(F.element_at(corner, w + 1), shift)).alias("corner"),
            ((state["turn"] + F.element_at(turn, w + 1) + 1) % n).alias("turn"),
        )

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("corner"), F.lit(0).alias("turn"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, level, lambda s: s["h"])


def category(column: Column, bits: int) -> Column:
    """A code for a category; different ones may share it. Null is 0."""
    return F.when(column.isNull(), 0).otherwise(F.pmod(F.xxhash64(column), F.lit(1 << bits)).cast("int"))


def magnitude(column: Column, cuts: list[int]) -> Column:
    """A code for a size: how many of the ascending cuts it reaches. Null is 0."""
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= column)), F.lit(0))


def shards(docs: DataFrame, n: int = 24, dimensions: tuple[str, ...] = ("lang", "source"), bits: int = 5, bucket_rows: int = 2048) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), curve and codes (the cell) of every document.

    The dimensions' codes and the text's size, in steps of equal shares of the documents, name a cell; documents lie in the order of their cells on the
    curve and are cut into ``n`` runs whose numbers of rows differ by one at most. So a shard covers few
    values of every dimension, and a reader with a filter on any of them skips shards (see :func:`manifest`).

    The global order needs no single sort: there are at most 2^(bits x dimensions) cells, whose counts are summed
    and added up in order; a cell with more than ``bucket_rows`` rows (or a millionth of all) is split by a hash into buckets, ranked one by one.

    ``docs`` needs doc_id and text; of ``dimensions`` those that are missing count as null, and other columns are
    ignored. A null text has size 8 and the crc32 of an empty one. Repeated rows and null ids get places of
    their own. With fewer rows than shards some shards stay empty; an empty table gives no rows.
    """
    has = set(docs.columns)
    dims = [docs[d].cast("string") if d in has else F.lit(None).cast("string") for d in dimensions]
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    facts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[d.alias(f"dim{i}") for i, d in enumerate(dims)])
    known = [category(F.col(f"dim{i}"), bits) for i in range(len(dims))]
    coded = saved(facts.select("doc_id", "size", "text_crc32", F.array(*known).alias("known"), F.monotonically_increasing_id().alias("row")), "coded")
    shares = F.array(*[F.lit(k / (1 << bits)) for k in range(1, 1 << bits)])
    cuts = sorted(set(coded.agg(F.percentile_approx("size", shares, 10_000)).first()[0] or []))
    codes = F.concat("known", F.array(magnitude(F.col("size"), cuts)))
    many = len(dims) + 1
    # the lambda's argument is evaluated once, however often the index refers to it
    cell = F.transform(F.array(codes), lambda c: F.struct(c.alias("codes"), hilbert_index([c[i] for i in range(many)], bits).alias("curve")))[0]
    placed = saved(coded.select("doc_id", "size", "text_crc32", "row", cell.alias("cell")).select("doc_id", "size", "text_crc32", "row", "cell.codes", "cell.curve"), "curve")
    release(coded)
    cells = placed.groupBy("curve").count()
    order = Window.partitionBy(F.lit(0)).orderBy("curve")
    cells = cells.withColumn("total", F.sum("count").over(Window.partitionBy(F.lit(0)))).select(
        "curve",
        F.ceil(F.col("count") / F.greatest(F.lit(bucket_rows), F.col("total") / 1_000_000)).cast("long").alias("buckets"),
        (F.sum("count").over(order) - F.col("count")).alias("before"),
        "total",
    )
    rows = placed.join(F.broadcast(cells), "curve").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row"), F.col("buckets")))
    counts = rows.groupBy("curve", "bucket").count()
    counts = counts.select("curve", "bucket", (F.sum("count").over(Window.partitionBy("curve").orderBy("bucket")) - F.col("count")).alias("skipped"))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("curve", "bucket").orderBy("doc_id", "row")) - 1)
    rank = F.col("before") + F.col("skipped") + F.col("nth")
    shard = F.expr(f"rank * {n} div total")
    return (
        ranked.join(counts, ["curve", "bucket"])
        .select("doc_id", "size", "text_crc32", "curve", "codes", "total", rank.alias("rank"))
        .withColumn("s", shard)
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("s").cast("int").alias("shard"), F.expr(f"rank - (s * total + {n - 1}) div {n}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", "codes")
    )


def manifest(placed: DataFrame) -> DataFrame:
    """A row for each shard of :func:`shards`: rows, bytes, least and largest size, and for each dimension the codes that occur, 2^bits at most."""
    sets = placed.select("shard", "size", F.posexplode("codes").alias("at", "code")).groupBy("shard", "at").agg(F.sort_array(F.collect_set("code")).alias("held"))
    sets = sets.groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "held"))), lambda x: x["held"]).alias("codes"))
    sizes = placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min("size").alias("least_size"), F.max("size").alias("most_size"))
    return sizes.join(sets, "shard")


def shards_for(held: DataFrame, categories: dict[int, str | None] | None = None, sizes: tuple[int, int] | None = None, bits: int = 5) -> DataFrame:
    """The rows of a manifest whose shards may hold documents with these values of category dimensions (by place) and sizes (both ends included)."""
    for at, value in (categories or {}).items():
        held = held.where(F.array_contains(F.col("codes")[at], category(F.lit(value).cast("string"), bits)))
    return held.where(F.col("least_size").between(0, sizes[1]) & (F.col("most_size") >= sizes[0])) if sizes else held
