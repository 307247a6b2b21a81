"""Text similarity of known pairs and of a corpus against a reference set."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from quire.functions import text as T
from quire.operators import sketches as K
from quire.operators.packing import PROFILES
from quire.session import freed, materialised


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(T.WORD), F.lit(0))


def bag_dice_all(pairs: DataFrame, left: str, rights: dict[str, str], key: str = "doc_id") -> DataFrame:
    """key and, per entry name -> column of ``rights``, its similarity to ``left``: 2 x common / total tokens x 100, as
    multisets; two empty texts are 100.

    All texts of a row are exploded into one stream of tokens with their side, which is counted before the shuffle; no
    join is needed.
    """

    def sided(name: str, side: int) -> Column:
        return F.transform(tokens(F.coalesce(name, F.lit(""))), lambda t: F.struct(t.alias("tok"), F.lit(side).alias("side")))

    texts = [left, *rights.values()]
    stream = pairs.select(key, F.explode_outer(F.concat(*[sided(n, i) for i, n in enumerate(texts)])).alias("e"))
    counts = stream.groupBy(key, F.col("e.tok").alias("tok")).agg(
        *[F.count_if(F.col("e.side") == i).alias(f"n{i}") for i in range(len(texts))]
    )
    sums = counts.groupBy(key).agg(
        *[F.sum(F.least("n0", f"n{i}")).alias(f"common{i}") for i in range(1, len(texts))],
        *[F.sum(F.col("n0") + F.col(f"n{i}")).alias(f"total{i}") for i in range(1, len(texts))],
    )

    def score(i: int) -> Column:
        ratio = F.round(F.col(f"common{i}").cast("decimal(20,6)") * 200 / F.nullif(F.col(f"total{i}"), F.lit(0)), 2)
        return F.coalesce(ratio.cast("double"), F.lit(100.0))

    return sums.select(key, *[score(i).alias(n) for i, n in enumerate(rights, 1)])


def bag_dice(pairs: DataFrame, left: str = "source", right: str = "rendered", key: str = "doc_id") -> DataFrame:
    """key, similarity of two text columns."""
    return bag_dice_all(pairs, left, {"similarity": right}, key)


def heading_match(pairs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, expected, matched, ratio: expected heading texts contained in any rendered line of the same document."""
    heads = F.transform(
        F.filter(
            F.transform(T.split_lines(F.col("source")), T.strip),
            lambda s: F.startswith(s, F.lit("#")),
        ),
        lambda s: F.lower(T.strip(F.ltrim(s, F.lit("# ")))),
    )
    rendered = F.filter(
        F.transform(T.split_lines(F.col("rendered")), lambda s: F.lower(T.strip(s))), lambda s: s != ""
    )
    # A heading inside some line is a heading inside the newline-joined lines, as headings hold no line break.
    body = F.array_join(rendered, "\n")
    rows = pairs.select("doc_id", *keep, heads.alias("_heads"), body.alias("_body"))
    rows = rows.select(
        "doc_id",
        *keep,
        F.size("_heads").alias("expected"),
        T.let(F.col("_body"), lambda b: F.size(F.filter("_heads", lambda h: F.contains(b, h)))).alias("matched"),
    )
    ratio = F.round(F.col("matched").cast("decimal(12,6)") / F.col("expected"), 2).cast("double")
    return rows.withColumn("ratio", F.when(F.col("expected") == 0, 1.0).otherwise(ratio))


#: Buckets of the frequency table that orders elements; entries of an inverted list that meet in one task.
BUCKETS, TILE = 1 << 14, 4096
#: Bags and bytes of sketches in a block of ``similar_pairs``, and pieces of a block whose bags are compared in one place.
BLOCK, BLOCK_BYTES, PIECES = 1 << 16, 16 << 20, 64
#: 64-bit words of the table of fixed size that says which bags have no pair.
FILTER = 1 << 17
#: Similarities are compared as whole ten-thousandths.
_UNIT = K.UNIT
#: Pairs of sketches in an Arrow batch, at least.
_PAIRS = 1 << 16


def bag_rows(df: DataFrame, id_col: str, group: Column | None = None, sizes: tuple[float, float] | None = None) -> DataFrame:
    """id_col, grp, row, h, n, bag: every row's sorted tokens joined by blanks, their number and digest, and a number of the
    row; rows without tokens, or with a number of them outside ``sizes``, are left out.

    Written once to the session's shared folder, so a text is tokenised once however often its bag is used.
    """
    grp = F.coalesce(group.cast("string"), F.lit("")) if group is not None else F.lit("")
    toks = T.settle(df.select(id_col, "text", grp.alias("grp")), [id_col, "grp"], toks=F.sort_array(tokens(F.col("text")))).filter(F.size("toks") > 0)
    if sizes:
        toks = toks.filter(F.size("toks").between(*sizes))
    bags = toks.select(id_col, "grp", F.size("toks").alias("n"), F.array_join("toks", " ").alias("bag"))
    digest = F.substring(F.unhex(F.sha2("bag", 256)), 1, 16)
    rows = bags.select(id_col, "grp", F.monotonically_increasing_id().alias("row"), digest.alias("h"), "n", "bag")
    return materialised(rows, "token-rows", compression="zstd")


def bag_classes(rows: DataFrame, id_col: str) -> DataFrame:
    """id_col, grp, class_id: the smallest identifier among the rows of the group with the same tokens."""
    heads = rows.groupBy("grp", "h").agg(F.min(id_col).alias("class_id"))
    return rows.select(id_col, "grp", "h").join(heads, ["grp", "h"]).select(id_col, "grp", "class_id")


def _bags(rows: DataFrame, id_col: str) -> DataFrame:
    """grp, h, n, rep, els: each distinct bag of a group once, its elements being (token, how many of it so far)."""
    one = rows.groupBy("grp", "h", "n").agg(F.min(id_col).alias("rep"), F.any_value("bag").alias("bag"))
    # Counts stay where the bag is: group and digest are part of every key.
    counts = one.select("grp", "h", "n", "rep", F.explode(F.split("bag", " ")).alias("tok")).groupBy("grp", "h", "n", "rep", "tok").agg(F.count("*").alias("k"))
    each = F.transform(F.sequence(F.lit(1).cast("long"), F.col("k")), lambda i: F.concat("tok", F.lit("\u0001"), i.cast("string")))
    return materialised(counts.groupBy("grp", "h", "n", "rep").agg(F.flatten(F.collect_list(each)).alias("els")), "bags")


def _bucket(el: Column) -> Column:
    return F.pmod(F.xxhash64(el), F.lit(BUCKETS)).cast("int")


def _frequencies(elements: DataFrame) -> list[int]:
    """How many of ``elements`` (b, their bucket) fall into each: BUCKETS numbers, whatever the data."""
    counts = elements.groupBy("b").agg(F.count("*").alias("n")).toArrow()
    out = [0] * BUCKETS
    for b, n in zip(counts["b"].to_pylist(), counts["n"].to_pylist(), strict=True):
        out[b] = n
    return out


def _numbers(values: list[int]) -> Column:
    """One constant array."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _prefixes(bags: DataFrame, counts: list[int], least: int) -> DataFrame:
    """grp, h, n, el, place: of each bag the elements, rarest first, of which a partner must share one.

    An element is its 64-bit hash here, in the order as in the join. Two that agree count as one, so a pair's share is never
    put too low; pairs found are compared by the elements themselves.
    """
    order = _numbers(counts)
    ranked = F.sort_array(F.transform("els", lambda e: F.struct(F.get(order, _bucket(e)).alias("f"), F.xxhash64(e).alias("el"))))
    over = 2 * _UNIT - least
    keep = F.col("n") - F.expr(f"cast((cast(n as bigint) * {least} + {over - 1}) div {over} as int)") + 1
    cut = bags.select("grp", "h", "n", F.slice(ranked, F.lit(1), keep).alias("first"))
    return cut.select("grp", "h", "n", F.posexplode("first").alias("place", "e")).select("grp", "h", "n", F.col("e.el").alias("el"), "place")


def _near_bags(left: DataFrame, right: DataFrame, least: int, tile: int) -> DataFrame:
    """grp, l_rep, r_rep, l_h, r_h, dice (a decimal): pairs of bags of a group from ``least`` ten-thousandths on.

    Elements are ordered rarest first by a bucketed frequency table of fixed size; a pair must share an element of both
    prefixes and be near enough in size. What it shares up to the last such element is counted; with the elements that
    either side has behind it, that must still be enough.
    Entries of a long inverted list are cut into tiles, and every two tiles meet in a task of their own.
    """
    each = lambda bags: bags.select(F.explode("els").alias("el")).select(_bucket(F.col("el")).alias("b"))
    order = _frequencies(each(left).unionAll(each(right)))
    bucket = F.pmod("el", F.lit(BUCKETS)).cast("int")
    lp, rp = _prefixes(left, order, least), _prefixes(right, order, least)
    l_size, r_size = _frequencies(lp.select(bucket.alias("b"))), _frequencies(rp.select(bucket.alias("b")))

    def dealt(prefix: DataFrame, own: list[int], other: list[int], side: str, mine_first: bool) -> DataFrame:
        parts = lambda counts: F.get(_numbers([max(1, -(-n // tile)) for n in counts]), bucket)
        rows = prefix.select("*", F.pmod(F.xxhash64("h"), parts(own)).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), parts(other) - 1)).alias("other"))
        first, second = ("own", "other") if mine_first else ("other", "own")
        pair = F.shiftleft(first, 32) + F.col(second)
        return rows.select("grp", "el", pair.alias("tiles"), *[F.col(c).alias(f"{side}_{c}") for c in ("h", "n", "place")])

    l, r = dealt(lp, l_size, r_size, "l", True), dealt(rp, r_size, l_size, "r", False)
    n = lambda side: F.col(f"{side}_n").cast("long")
    sizes = (n("l") * (2 * _UNIT - least) >= n("r") * least) & (n("r") * (2 * _UNIT - least) >= n("l") * least)
    found = l.join(r, ["grp", "el", "tiles"]).where(sizes).groupBy("grp", "l_h", "r_h", "l_n", "r_n").agg(
        F.count("*").alias("shared"), F.max("l_place").alias("l_place"), F.max("r_place").alias("r_place")
    )
    behind = F.least(n("l") - F.col("l_place"), n("r") - F.col("r_place")) - 1
    found = found.where((F.col("shared") + behind) * (2 * _UNIT) >= (n("l") + n("r")) * least).select("grp", "l_h", "r_h")
    bag = lambda b, side: b.select("grp", *[F.col(c).alias(f"{side}_{c}") for c in ("h", "n", "rep", "els")])
    both = found.join(bag(left, "l"), ["grp", "l_h"]).join(bag(right, "r"), ["grp", "r_h"])
    common = F.size(F.array_intersect("l_els", "r_els")).cast("long")
    both = both.select("grp", "l_h", "r_h", "l_rep", "r_rep", common.alias("c"), (n("l") + n("r")).alias("total"))
    dice = F.col("c").cast("decimal(20,6)") * 2 / F.col("total")
    return both.where(F.col("c") * (2 * _UNIT) >= F.col("total") * least).select("grp", "l_h", "r_h", "l_rep", "r_rep", dice.alias("dice"))


def _percent(dice: Column) -> Column:
    return F.round(dice * 100, 2).cast("double")


def similarity_join(corpus: DataFrame, refs: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """left_id, right_id, similarity: all pairs (corpus row, reference row) with multiset Dice >= threshold.

    Exact: see ``_near_bags``. Equal bags are compared once and expanded at the end; each text is tokenised once.
    """
    least = round(threshold * _UNIT)
    rows_r = bag_rows(refs, "right_id")
    low, high = rows_r.agg(F.min("n"), F.max("n")).first()
    share = least / (2 * _UNIT - least)
    # A corpus row that differs too much in size from every reference row is not looked at further.
    rows_l = bag_rows(corpus, "left_id", sizes=(int((low or 0) * share), int((high or 0) / share) + 1))
    hits = _near_bags(_bags(rows_l, "left_id"), _bags(rows_r, "right_id"), least, tile)
    pairs = hits.join(rows_l.select("left_id", F.col("h").alias("l_h")), "l_h").join(rows_r.select("right_id", F.col("h").alias("r_h")), "r_h")
    return pairs.select("left_id", "right_id", _percent(F.col("dice")).alias("similarity"))


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The key and the rows of each run of equal keys in each batch."""
    for batch in batches:
        keys = np.asarray(batch[key])
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if a < b:
                yield int(keys[a]), batch.slice(a, b - a)


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, at least _PAIRS at a time."""
    held, count = [], 0
    for pair in pairs:
        held.append(pair)
        count += len(pair[0])
        if count >= _PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, count = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _typed(df: DataFrame, **more) -> StructType:
    out = StructType(list(df.schema.fields))
    for name, kind in more.items():
        out = out.add(name, kind)
    return out


def _sketched(rows: DataFrame, id_col: str) -> DataFrame:
    """grp, n, rep, row, sketch: each distinct bag of a group once, with the smallest identifier and row that have it."""
    named = rows.select("grp", "h", "n", F.col(id_col).alias("rep"), "row", "bag")
    keep = named.drop("bag")
    names = [*keep.columns, "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.sliced(batch, "bag"):
                yield pa.RecordBatch.from_arrays([*[part[c] for c in names[:-1]], K.sketched(part["bag"])], names)

    made = named.mapInArrow(run, _typed(keep, sketch=BinaryType()))
    one = made.groupBy("grp", "h", "n").agg(F.min("rep").alias("rep"), F.min("row").alias("row"), F.any_value("sketch").alias("sketch"))
    return materialised(one.drop("h"), "bag-sketches")


def _tiles(bags: DataFrame, least: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """The bags with their block and piece, and a row per two blocks of a group that can hold similar bags.

    A group's bags are laid out by size. Blocks are cut from that, of at most about ``tile`` bags and BLOCK_BYTES of
    sketches; bags of a size that fills more than a piece are dealt to pieces by a hash. Bags are only counted by size, so
    what a group is ordered by has a row per size.
    """
    piece = BLOCK_BYTES // PIECES
    weight = F.greatest(F.max(F.length("sketch")) + 64, F.lit(-(-BLOCK_BYTES // tile))).cast("long")
    sizes = bags.groupBy("grp", "n").agg((F.count("*") * weight).alias("fill"))
    before = F.coalesce(F.sum("fill").over(Window.partitionBy("grp").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("grp", "n", F.expr(f"fill div {piece} + if(fill % {piece} > 0, 1, 0)").alias("parts"), before.alias("before"))
    sizes = materialised(sizes.select("grp", "n", "parts", F.expr(f"before div {piece}").alias("piece")), "bag-sizes")
    placed = bags.join(sizes, ["grp", "n"]).withColumn("piece", F.col("piece") + F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts")
    blocks = sizes.select("grp", "n", F.explode(F.expr(f"sequence(piece div {PIECES}, (piece + parts - 1) div {PIECES})")).alias("block"))
    blocks = blocks.groupBy("grp", "block").agg(F.min("n").cast("long").alias("lo"), F.max("n").cast("long").alias("hi"))
    side = lambda s: blocks.select("grp", *[F.col(c).alias(f"{s}_{c}") for c in ("block", "lo", "hi")])
    near = (F.col("l_block") <= F.col("r_block")) & (F.col("r_lo") * least <= F.col("l_hi") * (2 * _UNIT - least))
    tiles = side("l").join(side("r"), "grp").where(near).withColumn("tile", F.monotonically_increasing_id())
    return placed.withColumn("block", F.expr(f"piece div {PIECES}")), materialised(tiles, "bag-tiles")


def _near_sketches(bags: DataFrame, least: int, tile: int) -> DataFrame:
    """grp, meet, l_row, r_row, l_rep, r_rep, total: pairs of bags whose sketches do not rule out the similarity.

    Every two blocks meet in one place, where all pairs near enough in size are compared by sketch; nothing but these
    sketches moves. Pairs with one number ``meet`` have their bags in the same two pieces.
    """
    placed, tiles = _tiles(bags, least, tile)

    def to(own: str, other: str, side: int) -> DataFrame:
        near = [F.col(f"{own}_block").alias("block"), F.col(f"{other}_lo").alias("lo"), F.col(f"{other}_hi").alias("hi")]
        return tiles.select("grp", "tile", F.lit(side).alias("side"), *near, (F.col("l_block") == F.col("r_block")).alias("same"))

    to_tiles = to("l", "r", 0).unionAll(to("r", "l", 1).where(~F.col("same")))
    n = F.col("n").cast("long")
    fits = (n * (2 * _UNIT - least) >= F.col("lo") * least) & (F.col("hi") * (2 * _UNIT - least) >= n * least)
    moved = placed.join(to_tiles, ["grp", "block"]).where(fits).select("tile", "side", "same", "grp", n.alias("n"), F.expr(f"piece % {PIECES}").alias("piece"), "row", "rep", "sketch")
    width = int(bags.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = moved.repartition(width, "tile").sortWithinPartitions("tile", "side", "n")

    names = ["grp", "meet", "l_row", "r_row", "l_rep", "r_rep", "total"]

    def found(key: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        columns = {c: rows[c].combine_chunks() for c in ("grp", "row", "rep", "sketch")}
        n, piece = np.asarray(rows["n"]), np.asarray(rows["piece"])
        same = rows["same"][0].as_py()
        cut = 0 if same else int(np.searchsorted(np.asarray(rows["side"]), 1))
        end = rows.num_rows if same else cut
        if not end or cut == rows.num_rows:
            return
        sketch = columns["sketch"]
        for i, j in _gathered(K.near(n[:end], sketch[:end], n[cut:], sketch[cut:], least, same)):
            j = j + cut
            meet = (key * PIECES + piece[i]) * PIECES + piece[j]
            taken = [columns[c].take(pa.array(x)) for c, x in (("grp", i), ("row", i), ("row", j), ("rep", i), ("rep", j))]
            yield pa.RecordBatch.from_arrays([taken[0], pa.array(meet), *taken[1:], pa.array(n[i] + n[j])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None
        for key, part in _runs(batches, "tile"):
            if key != own and held:
                yield from found(own, held)
                held = []
            own = key
            held.append(part)
        if held:
            yield from found(own, held)

    rep = bags.schema["rep"].dataType
    schema = _typed(bags.select("grp"), meet=LongType(), l_row=LongType(), r_row=LongType(), l_rep=rep, r_rep=rep, total=LongType())
    return materialised(moved.mapInArrow(run, schema), "near-bags")


def _compared(near: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """grp, l_rep, r_rep, c, total: of the pairs those that are similar, by the tokens of the bags themselves.

    A bag with a pair moves once to every two pieces where it has one. A table of bits, of a fixed size, keeps most others
    from moving at all.
    """
    need = near.select("meet", F.col("l_row").alias("row")).unionAll(near.select("meet", F.col("r_row").alias("row")))
    word, bit = F.expr(f"pmod(xxhash64(row), {FILTER})"), "cast(shiftrightunsigned(xxhash64(row), 58) as int)"
    table = need.select(word.alias("word"), F.expr(f"shiftleft(1L, {bit})").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    likely = rows.select("row", "bag", word.alias("word")).join(F.broadcast(table), "word").where(F.expr(f"shiftrightunsigned(bits, {bit}) & 1 = 1"))
    bags = need.distinct().join(likely.select("row", "bag"), "row").select("meet", F.lit(0).alias("kind"), F.col("row").alias("l_row"), "bag")
    both = near.withColumn("kind", F.lit(1)).unionByName(bags, allowMissingColumns=True)
    width = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(width, "meet").sortWithinPartitions("meet", "kind", "l_row")
    keep = ["grp", "l_rep", "r_rep", "c", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, bags, ids = None, [], None, None
        for key, part in _runs(batches, "meet"):
            if key != own:
                own, held, bags = key, [], None
            cut = int(np.searchsorted(np.asarray(part["kind"]), 1))
            if cut:
                held.append(part.slice(0, cut).select(["l_row", "bag"]))
            pairs = part.slice(cut)
            if not pairs.num_rows:
                continue
            if bags is None:  # all bags stand before the first pair
                table = pa.Table.from_batches(held).combine_chunks()
                ids, bags, held = np.asarray(table["l_row"]), K.Bags(table["bag"].combine_chunks()), []
            left, right = (np.searchsorted(ids, np.asarray(pairs[c])) for c in ("l_row", "r_row"))
            pairs = pairs.append_column("c", pa.array(bags.shared(left, right)))
            total = np.asarray(pairs["total"])
            yield pairs.filter(pa.array(np.asarray(pairs["c"]) * (2 * _UNIT) >= total * least)).select(keep)

    rep = near.schema["l_rep"].dataType
    return both.mapInArrow(run, _typed(near.select("grp"), l_rep=rep, r_rep=rep, c=LongType(), total=LongType()))


def similar_pairs(rows: DataFrame, id_col: str, threshold: float, tile: int = BLOCK) -> DataFrame:
    """grp, left_id, right_id, similarity: pairs of different bags of the same group with multiset Dice >= threshold.

    ``rows`` comes from ``bag_rows``. Rows with equal bags are one class (``bag_classes``), named by its smallest identifier;
    a pair names two classes, the smaller identifier first, and is made once.

    Exact: a sketch of a few bits an element bounds from below in how many elements two bags differ, all pairs near enough in
    size are held against that bound, and those left are compared by their tokens.
    """
    least = round(threshold * _UNIT)
    with freed(rows.sparkSession):
        near = _near_sketches(_sketched(rows, id_col), least, tile)
    hits = _compared(near, rows, least)
    dice = F.col("c").cast("decimal(20,6)") * 2 / F.col("total")
    return hits.select("grp", F.least("l_rep", "r_rep").alias("left_id"), F.greatest("l_rep", "r_rep").alias("right_id"), _percent(dice).alias("similarity"))


def gate(similarity: Column) -> Column:
    """The strictest acceptance profile whose similarity gate a percentage passes, or null."""
    out = F.lit(None).cast("string")
    for name, fields in sorted(PROFILES.items(), key=lambda x: x[1][0]):
        out = F.when(similarity >= fields[0], name).otherwise(out)
    return out


#: The lowest similarity gate of the profiles, as a share.
LOWEST_GATE = min(fields[0] for fields in PROFILES.values()) / 100
