"""Nearest-neighbour hot-deck: gaps filled from the closest records of the same group, else of the same season.

Records are hashed into blocks of a ladder: first the group (site), then
season and observed features (land use, elevation band), then the season, then
everything. Within a block donors are the nearest ones along an order (time in
a group, elevation in a season), found with windows over bounded chunks, so no
block is ever paired with itself and none has to fit into one task. Donors are
then weighted by the Gower distance of their observed mixed features; numbers
become the weighted median, categories the weighted majority.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phytoscape.session import materialise

_SALTS = 16  # tasks over which rows of one block and order are spread while chunks are numbered


@dataclass(frozen=True)
class Field:
    """A column to fill: numeric with limits (both included), or categorical with its allowed lower-case values."""

    name: str
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()

    def usable(self) -> tuple[Column, Column]:
        """(number, category): the cell's usable value, NULL where it has none."""
        c = F.col(self.name)
        none = F.lit(None)
        if self.values:
            v = F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""))
            return none.cast("double"), F.when(v.isin(*self.values), v)
        v = c.cast("double")
        ok = v.isNotNull() & ~F.isnan(v)
        if self.low is not None:
            ok &= v >= self.low
        if self.high is not None:
            ok &= v <= self.high
        return F.when(ok, v), none.cast("string")


@dataclass(frozen=True)
class HotDeck:
    """Names of the columns the operator works with, and its parameters.

    donors: nearest donors taken on either side. chunk_rows: rows of a block
    that one window may hold; larger blocks are cut into chunks along their
    order, and donors are carried over from the chunks beside.
    """

    key: str
    group: str
    time: str
    arrived: str
    fields: tuple[Field, ...]
    numeric: tuple[tuple[str, float], ...] = field(default=())
    categorical: tuple[str, ...] = ()
    band: tuple[str, float] | None = None
    donors: int = 3
    chunk_rows: int = 5_000

    def columns(self) -> tuple[str, ...]:
        """The columns that the operator reads beside key and arrival."""
        return tuple(dict.fromkeys([self.group, self.time, *[f.name for f in self.fields], *[n for n, _ in self.numeric], *self.categorical]))


def latest(df: DataFrame, key: str, arrived: str, first: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: the last to arrive (ties: the greatest row, compared by the columns ``first``, then by the others). Rows without key are left out."""
    rest = list(dict.fromkeys([arrived, *first, *[c for c in df.columns if c != key]]))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*rest)).alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in rest])


def _nearest(rows: DataFrame, block: list[str], count: int, k: int, chunk_rows: int) -> DataFrame:
    """(key, f, field number, near) of every cell that needs a value: up to k donors before and k after its row along ``ord`` within its block, and as many from the chunks beside.

    rows: block columns, ord (double, never NULL), key, f, and for each of the
    ``count`` fields v{i} (value, NULL for cells that cannot give) and n{i}
    (needs one). Donors of equal order count on the side of their key; a row is
    never its own donor. Whole rows travel, once per rung; the donors' structs
    are made after the shuffle. Blocks without a needing cell are left out.
    """
    some = F.lit(False)
    for i in range(count):
        some = some | F.col(f"n{i}")
    blocks = materialise(rows.groupBy(*block).agg(F.count("*").alias("_all"), F.count_if(some).alias("_open")).where((F.col("_all") > chunk_rows) & (F.col("_open") > 0)).select(*block))
    has_big = not blocks.isEmpty()
    if has_big:
        run = Window.partitionBy(*block).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        steps = (
            rows.join(blocks, block, "left_semi").groupBy(*block, "ord").agg(F.count("*").alias("_n"))
            .withColumn("_chunk", F.floor(F.coalesce(F.sum("_n").over(run), F.lit(0)) / chunk_rows))
            .withColumn("_parts", F.ceil(F.col("_n") / chunk_rows)).drop("_n")
        )
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(_SALTS)))  # many rows may share one order: the join is spread over salts
        steps = steps.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_SALTS - 1).cast("bigint"))))
        rows = (
            salted.join(steps, [*block, "ord", "_salt"], "left").drop("_salt")
            .withColumn("_part", F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("key"), F.col("_parts"))).otherwise(F.lit(0)))
            .withColumn("_chunk", F.coalesce(F.col("_chunk"), F.lit(-1))).drop("_parts")
        )
    else:
        rows = rows.withColumn("_part", F.lit(0)).withColumn("_chunk", F.lit(-1))
    own = [*block, "_chunk", "_part"]
    rows = rows.repartition(*own)

    def around(i: int) -> Column:
        text = f"case when v{i} is not null then struct(key, v{i}.num as num, v{i}.cat as cat, f) end"
        over = f"IGNORE NULLS OVER (PARTITION BY {', '.join(own)} ORDER BY ord, key)"
        return F.array(*[F.expr(f"{name}({text}, {n}) {over}") for name in ("lag", "lead") for n in range(1, k + 1)])

    cells = F.filter(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"n{i}").alias("need"), F.col(f"_near{i}").alias("near")) for i in range(count)]), lambda c: c["need"])
    asks = rows.select("*", *[around(i).alias(f"_near{i}") for i in range(count)]).where(some)
    near = asks.select("key", "f", *own, F.explode(cells).alias("c")).select("key", "f", *own, "c.field", "c.near")
    if has_big:
        ends = []
        for i in range(count):
            all_ = F.array_sort(F.collect_list(F.when(F.col(f"v{i}").isNotNull(), F.struct("ord", "key", F.struct("key", f"v{i}.num", f"v{i}.cat", "f").alias("d")))))  # chunk_rows at most
            some_ = lambda a: F.when(F.size(a) > 0, F.transform(F.slice(a, 1, k), lambda x: x["d"]))
            ends.append(F.struct(F.lit(i).alias("field"), some_(all_).alias("_first"), some_(F.reverse(all_)).alias("_last")))
        edges = rows.where("_chunk >= 0").groupBy(*own).agg(F.array(*ends).alias("e")).select(*own, F.explode("e").alias("e")).select(*own, "e.*")
        by = ", ".join([*block, "field"])
        lists = [F.expr(f"{name}({what}, {n}) IGNORE NULLS OVER (PARTITION BY {by} ORDER BY _chunk, _part)") for name, what in (("lag", "_last"), ("lead", "_first")) for n in range(1, k + 1)]
        carried = edges.select(*own, "field", F.flatten(F.filter(F.array(*lists), lambda a: a.isNotNull())).alias("_carried"))
        near = near.join(carried, [*own, "field"], "left").withColumn("near", F.concat("near", F.coalesce("_carried", F.filter("near", lambda d: F.lit(False))))).drop("_carried")
    return near.select("key", "f", "field", F.filter("near", lambda d: d.isNotNull() & (d["key"] != F.col("key"))).alias("near"))


def _filled(near: DataFrame, deck: HotDeck) -> DataFrame:
    """Weighs the donors of each cell by Gower distance, keeps the closest and takes weighted median or majority."""
    names = F.array(*[F.lit(f.name) for f in deck.fields])
    nominal = F.array(*[F.lit(bool(f.values)) for f in deck.fields])
    rows = near.select("key", F.get(names, F.col("field")).alias("field"), F.get(nominal, F.col("field")).alias("nominal"), "f", F.explode("near").alias("d"))
    apart = lambda n: F.abs(F.col(f"f.{n}") - F.col(f"d.f.{n}"))
    parts = [F.when(apart(n).isNotNull(), F.least(F.lit(1.0), apart(n) / scale)) for n, scale in (("_t", 365.0), *deck.numeric)]  # features missing on either side do not count
    parts += [F.when(F.col(f"f.{n}") == F.col(f"d.f.{n}"), 0.0).when(F.col(f"f.{n}").isNotNull() & F.col(f"d.f.{n}").isNotNull(), 1.0) for n in deck.categorical]
    gaps = F.filter(F.array(*parts), lambda x: x.isNotNull())
    rows = rows.select("key", "field", "nominal", F.coalesce(F.try_divide(F.aggregate(gaps, F.lit(0.0), lambda t, x: t + x), F.size(gaps)), F.lit(1.0)).alias("dist"), F.col("d.key").alias("donor"), "d.num", "d.cat")
    closest = Window.partitionBy("key", "field").orderBy("dist", "donor")
    rows = rows.withColumn("rank", F.row_number().over(closest)).where(F.col("rank") <= 2 * deck.donors - 1).withColumn("w", F.round(1.0 / (0.05 + F.col("dist")), 9))
    cell = Window.partitionBy("key", "field")
    rows = rows.withColumn("upto", F.sum("w").over(cell.orderBy("num", "donor"))).withColumn("total", F.sum("w").over(cell)).withColumn("votes", F.sum("w").over(Window.partitionBy("key", "field", "cat")))
    # ties between categories go to the alphabetically greatest
    return rows.groupBy("key", "field").agg(
        F.min(F.when(~F.col("nominal") & (F.col("upto") >= F.col("total") / 2), F.col("num"))).alias("num"),
        F.max(F.when(F.col("nominal"), F.struct(F.round("votes", 6).alias("v"), F.col("cat").alias("cat"))))["cat"].alias("cat"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "donor"))), lambda x: x["donor"]).alias("donors"),
    )


def hot_deck(df: DataFrame, deck: HotDeck, only: str | None = None) -> DataFrame:
    """Every cell without usable value that can be filled: (key, field, num, cat, donors, block).

    ``block`` names the rung of the ladder that gave the donors: group,
    season_features, season or all; ``only="group"`` stops after the first.
    Repeated rows of a key count once (the last
    to arrive); rows without key are left out; a missing group skips the first
    rung; a missing time counts as day 0; cells for which no record at all has
    a value stay unfilled and are not reported. Numbers are copied from a donor
    (lower weighted median), categories by weighted majority.
    """
    needed = deck.columns()
    rows = latest(df.select(deck.key, deck.arrived, *needed), deck.key, deck.arrived, needed)
    day = F.coalesce(F.datediff(F.col(deck.time), F.lit("1970-01-01")), F.lit(0)).cast("double")
    features = [day.alias("_t"), *[F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")).alias(n) for n, _ in deck.numeric], *[F.lower(F.trim(F.col(n).cast("string"))).alias(n) for n in deck.categorical]]
    values, count = [], len(deck.fields)
    for i, f in enumerate(deck.fields):
        num, cat = f.usable()
        values.append(F.when(num.isNotNull() | cat.isNotNull(), F.struct(num.alias("num"), cat.alias("cat"))).alias(f"v{i}"))
    band = F.floor(F.col(f"f.{deck.band[0]}") / deck.band[1]) if deck.band else F.lit(None).cast("bigint")
    whole = (
        rows.select(F.col(deck.key).alias("key"), F.col(deck.group).alias("grp"), F.coalesce(F.quarter(F.col(deck.time)), F.lit(0)).alias("season"), F.struct(*features).alias("f"), *values)
        .withColumns({f"n{i}": F.col(f"v{i}").isNull() for i in range(count)})
        .withColumn("traits", F.xxhash64("season", band, *[F.coalesce(F.col(f"f.{n}"), F.lit("?")) for n in deck.categorical]))
    )
    whole = materialise(whole)  # every rung reads it several times
    height = F.coalesce(F.col(f"f.{deck.band[0]}"), F.lit(0.0)) if deck.band else F.col("f._t")
    rungs = [("group", "grp", F.col("f._t")), ("season_features", "traits", height), ("season", "season", height), ("all", "one", height)]
    whole = whole.withColumn("one", F.lit(1))
    out, open_ = None, None
    for name, block, order in rungs:
        own = whole.where(F.col(block).isNotNull())
        if open_ is not None:  # only the cells that are still open ask
            flags = open_.groupBy("key").agg(F.collect_set("field").alias("_open"))  # one element per field
            own = own.join(flags, "key", "left").withColumns({f"n{i}": F.coalesce(F.array_contains("_open", f.name), F.lit(False)) for i, f in enumerate(deck.fields)}).drop("_open")
        own = own.select("key", block, "f", order.alias("ord"), *[f"{c}{i}" for i in range(count) for c in "vn"])
        if open_ is not None:  # and only blocks that hold such a cell give
            asked = own.where(" or ".join(f"n{i}" for i in range(count))).select(block).distinct()
            own = own.join(asked, block, "left_semi")
        found = _filled(_nearest(own, [block], count, deck.donors, deck.chunk_rows), deck).withColumn("block", F.lit(name))
        if only == name:
            return found
        found = materialise(found)  # else each rung's plan would hold those before several times
        out = found if out is None else out.unionByName(found)
        if open_ is None:
            open_ = whole.select("key", F.explode(F.filter(F.array(*[F.when(F.col(f"n{i}"), F.lit(f.name)) for i, f in enumerate(deck.fields)]), lambda x: x.isNotNull())).alias("field"))
        open_ = materialise(open_.join(found.select("key", "field"), ["key", "field"], "left_anti"))
        if open_.isEmpty():
            break
    return out


def filled_table(df: DataFrame, deck: HotDeck) -> DataFrame:
    """The latest row of each key with every field filled where possible and a ``<field>_filled`` mark beside it."""
    cells = hot_deck(df, deck)
    names = {f.name: f for f in deck.fields}
    picked = cells.groupBy("key").agg(*[F.max(F.when(F.col("field") == n, F.struct("num", "cat"))).alias(f"_{n}") for n in names])
    rows = latest(df, deck.key, deck.arrived, deck.columns()).join(picked.withColumnRenamed("key", deck.key), deck.key, "left")
    for n, f in names.items():
        num, cat = f.usable()
        own, new = (cat, F.col(f"_{n}")["cat"]) if f.values else (num, F.col(f"_{n}")["num"])
        rows = rows.withColumn(f"{n}_filled", F.col(f"_{n}").isNotNull()).withColumn(n, F.coalesce(own, new))
    return rows.drop(*[f"_{n}" for n in names])
