"""Three-way merge of table versions by descent of Merkle trees.

A version is a table of rows with an id, columns, and a text as an array of slots. A slot is a place in the text that keeps its number in
all versions: its ``line`` (null where the version has dropped it) and its ``gap``, the line inserted after it (null: none).

Every version gets a tree: hashes of slots make those of blocks of 64, these and hashes of columns make that of a row, and rows make that of one of 4096
buckets of ids. The buckets of the three versions are compared first, and rows of equal ones are passed through. In the others the trees of rows
meet by id, without their contents; the contents of rows are read where the trees differ, columns and blocks where their hashes differ, and only slots in
differing blocks are merged one by one.

Equal subtrees are told by 64-bit hashes that are compared within one id and place; two different ones pass for equal once in 2^64 comparisons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 64
BUCKETS = 4096
SLOTS = "array<struct<line:string,gap:string>>"
COUNTS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")
_BASE, _LEFT, _RIGHT = range(3)


def unique(rows: DataFrame, id_col: str) -> DataFrame:
    """One row for each id: of rows that share one the least by their values stands. Rows without an id stay."""
    if rows.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        return rows
    others = [c for c in rows.columns if c != id_col]
    once = rows.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.struct(*others)).alias("v"))
    return once.select(id_col, *(F.col("v")[c].alias(c) for c in others)).unionByName(rows.where(F.col(id_col).isNull()))


def lines_of(text: Column) -> Column:
    """The slots of a text that no version has changed: its lines between \\n, an empty text one empty line; null like empty."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.struct(x.alias("line"), F.lit(None).cast("string").alias("gap")))


def text_of(slots: Column) -> Column:
    """What is left of the slots, between \\n; no line at all gives an empty text."""
    return F.array_join(F.flatten(F.transform(slots, lambda s: F.array(s["line"], s["gap"]))), "\n")


def _leaf(*values: Column) -> Column:
    return F.xxhash64(*(x for v in values for x in (v.isNull(), v)))


def trees(version: DataFrame, id_col: str, columns: list[str], slots: str) -> DataFrame:
    """(id, bucket, row, cols, blocks): the hashes of each row's tree, without its contents."""
    leaves = F.transform(F.coalesce(slots, F.array().cast(SLOTS)), lambda s: _leaf(s["line"], s["gap"]))
    cut = version.select(F.col(id_col).alias("id"), F.array(*(_leaf(F.col(c)) for c in columns)).cast("array<long>").alias("cols"), leaves.alias("leaves"))
    starts = F.when(F.size("leaves") > 0, F.sequence(F.lit(1), F.size("leaves"), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda at: F.xxhash64(F.slice("leaves", at, BLOCK)))
    hashed = cut.select("id", "cols", blocks.alias("blocks"))
    return hashed.select("id", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("bucket"), F.xxhash64("id", "cols", F.size("blocks"), "blocks").alias("row"), "cols", "blocks")


def differing_buckets(nodes: DataFrame) -> DataFrame:
    """Buckets, of the ``BUCKETS`` there are, whose rows aren't the same in all versions. ``nodes``: v, bucket, row."""
    of = [F.struct(F.bit_xor(F.when(F.col("v") == v, F.col("row"))), F.count(F.when(F.col("v") == v, True))) for v in (_BASE, _LEFT, _RIGHT)]
    sums = nodes.groupBy("bucket").agg(*(x.alias(f"x{v}") for v, x in enumerate(of)))
    return sums.where("not (x0 <=> x1 and x0 <=> x2)").select("bucket")


def _merged(b: Column, x: Column, y: Column, left: Column, right: Column) -> Column:
    """The merged value; ``left``, ``right``: whether the branch has changed it."""
    return F.when(~left, y).when(~right, x).when(x.eqNullSafe(y), x).otherwise(b)


def _slot(b: Column, x: Column, y: Column) -> Column:
    """One slot merged, its line and its gap apart. A slot that a version lacks has neither."""
    changed = lambda v, k: ~v[k].eqNullSafe(b[k])
    clash = {k: changed(x, k) & changed(y, k) & ~x[k].eqNullSafe(y[k]) for k in ("line", "gap")}
    any_ = {k: changed(x, k) | changed(y, k) for k in ("line", "gap")}
    gone = {k: x[k].isNull() | y[k].isNull() for k in ("line", "gap")}
    kinds = {
        "n_clean": [any_[k] & ~clash[k] for k in clash],
        "n_edit_edit": [clash[k] & ~gone[k] & b[k].isNotNull() for k in clash],
        "n_edit_delete": [clash[k] & gone[k] for k in clash],
        "n_insert_insert": [clash[k] & ~gone[k] & b[k].isNull() for k in clash],
    }
    counts = [sum((t.cast("int") for t in tests), F.lit(0)).alias(n) for n, tests in kinds.items()]
    return F.struct(*(_merged(b[k], x[k], y[k], changed(x, k), changed(y, k)).alias(k) for k in clash), *counts)


def _slots(b: Column, x: Column, y: Column, hashes: tuple[Column, Column, Column]) -> Column:
    """All slots merged: blocks of equal hashes as they stand in the base, others slot by slot."""
    size = F.greatest(F.size(b), F.size(x), F.size(y))

    def block(k: Column) -> Column:
        at = [F.get(h, k) for h in hashes]
        places = F.sequence(k * BLOCK, F.least((k + 1) * BLOCK, size) - 1)
        as_is = F.transform(places, lambda j: F.struct(F.get(b, j)["line"].alias("line"), F.get(b, j)["gap"].alias("gap"), *(F.lit(0).alias(n) for n in COUNTS)))
        return F.when(at[0].eqNullSafe(at[1]) & at[0].eqNullSafe(at[2]), as_is).otherwise(F.transform(places, lambda j: _slot(F.get(b, j), F.get(x, j), F.get(y, j))))

    return F.when(size > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int")), block)))


def merge(versions: list[DataFrame], id_col: str, columns: list[str], slots: str = "slots", dropped: str | None = None, *, dealt: list[DataFrame] | None = None) -> DataFrame:
    """One row for each id of any of the ``versions`` (base, left, right), which have one row for each id (see ``unique``): id_col, columns, slots,
    present and the ``COUNTS`` of changes, as longs. ``dropped`` names a column that is true where a version has dropped the row. ``dealt``: the same
    versions with their rows dealt by id already, so that they need not be exchanged.

    Columns merge by value, slots line by line and gap by gap: a change of one branch, or the same change of both, counts one clean; two different ones count
    one conflict, and the base's state stays. Two edits are edit-edit, an edit and a drop edit-delete, two lines put into one gap insert-insert. A row
    that one branch dropped goes (clean) if the other left it alone, else it stays as in the base and counts one edit-delete; one that both
    dropped goes. A row that the base lacks counts as a whole: one clean if one branch has it or both have the same, else one insert-insert, and it is
    left out. Rows that are left out or gone have present = false and null columns and slots.

    Null columns are values like any other, null slots no slots. Rows of the base without an id can't be matched and are returned as they are, those of
    a branch are ignored. Other columns are left out, whatever their names; empty tables are versions without rows."""
    names = [*columns, slots]
    untouched = [F.lit(True).alias("present"), *(F.lit(0).cast("long").alias(n) for n in COUNTS)]
    nameless = versions[0].where(F.col(id_col).isNull()).select(id_col, *names, *untouched)
    held = [v.where(F.col(id_col).isNotNull()) for v in versions]
    held = [v.where(~F.coalesce(dropped, F.lit(False))) for v in held] if dropped else held
    hashed = [trees(v, id_col, columns, slots).withColumn("v", F.lit(k)) for k, v in enumerate(held)]
    nodes = common.stage(hashed[0].unionByName(hashed[1]).unionByName(hashed[2]), "merkle")
    differing = F.broadcast(common.stage(differing_buckets(nodes), "buckets"))  # at most BUCKETS numbers

    tree = F.struct("row", "cols", "blocks")
    keyed = nodes.join(differing, "bucket", "left_semi").groupBy("id").agg(*(F.first(F.when(F.col("v") == k, tree), ignorenulls=True).alias(f"t{k}") for k in (_BASE, _LEFT, _RIGHT)))
    wide = keyed
    for k, v in enumerate(dealt or versions):  # whether a version has a row is for its tree to say
        contents = v.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.struct(*names).alias(f"v{k}"))
        wide = wide.join(contents.hint("merge"), "id", "left")
    t, v = ([F.col(f"{p}{k}") for k in (_BASE, _LEFT, _RIGHT)] for p in "tv")
    has = [x.isNotNull() for x in t]
    rows = [x["row"] for x in t]
    whole = has[0] & has[1] & has[2]
    same = whole & (rows[0] == rows[1]) & (rows[0] == rows[2])
    # what becomes of rows that some version lacks: the version whose row stands (null: none), and what it counts as
    kept = F.when(has[1], rows[1]).otherwise(rows[2])
    alone = F.when(has[0], F.when(~has[1] & ~has[2] | (kept == rows[0]), F.lit("gone")).otherwise("edit_delete"))
    alone = alone.otherwise(F.when(has[1] & has[2] & (rows[1] != rows[2]), F.lit("insert_insert")).when(has[1], "left").otherwise("right"))
    fate = wide.withColumn("fate", F.when(same, "same").when(whole, "merge").otherwise(alone))
    both = lambda k: F.col("fate") == k

    edits = []  # of each column: changed by left, by right, differently
    for k in range(len(columns)):
        c = [F.get(x["cols"], F.lit(k)) for x in t]
        edits.append((c[1] != c[0], c[2] != c[0], (c[1] != c[0]) & (c[2] != c[0]) & (c[1] != c[2])))
    out = fate.withColumn("m", F.when(both("merge"), _slots(*(x[slots] for x in v), tuple(x["blocks"] for x in t))))
    total = lambda n: F.coalesce(F.aggregate("m", F.lit(0).cast("long"), lambda a, s: a + s[n]), F.lit(0).cast("long"))
    counted = {n: total(n) for n in COUNTS}
    for x, y, clash in edits:
        counted["n_clean"] += (both("merge") & (x | y) & ~clash).cast("long")
        counted["n_edit_edit"] += (both("merge") & clash).cast("long")
    counted["n_clean"] += F.col("fate").isin("gone", "left", "right").cast("long")
    counted["n_edit_delete"] += both("edit_delete").cast("long")
    counted["n_insert_insert"] += both("insert_insert").cast("long")

    def value(name: str, merged: Column) -> Column:
        return F.when(both("merge"), merged).when(both("same") | both("edit_delete"), v[0][name]).when(both("left"), v[1][name]).when(both("right"), v[2][name])

    columns_out = [value(c, _merged(v[0][c], v[1][c], v[2][c], x, y)).alias(c) for c, (x, y, _) in zip(columns, edits, strict=True)]
    plain = F.coalesce(F.transform("m", lambda s: F.struct(s["line"].alias("line"), s["gap"].alias("gap"))), v[0][slots])  # null: no version has a slot
    present = ~F.col("fate").isin("gone", "insert_insert")
    descended = out.select(F.col("id").alias(id_col), *columns_out, value(slots, plain).alias(slots), present.alias("present"), *(c.alias(n) for n, c in counted.items()))
    skipped = held[0].withColumn("bucket", F.pmod(F.xxhash64(id_col), F.lit(BUCKETS)).cast("int")).join(differing, "bucket", "left_anti")
    return descended.unionByName(skipped.select(id_col, *names, *untouched)).unionByName(nameless)


# ---- the query ----


def _code(branch: str, *name: Column | str) -> Column:
    parts = [F.col("doc_id").cast("string"), F.lit(":"), *(F.lit(n) if isinstance(n, str) else n.cast("string") for n in name)]
    return (F.crc32(F.concat(F.lit(branch + ":"), *parts)) % 11).cast("int")


def _edited(value: Column, code: Column, dropped: Column) -> Column:
    return F.when(code == 0, dropped).when(code == 1, F.concat(value, F.lit("!"))).when(code == 2, F.concat(value, F.lit("?"))).otherwise(value)


def branch(docs: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` as the branch has changed them, or dropped."""
    lines = F.split("text", "\n", -1)
    codes = F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda j: _code(name, j))
    nothing = F.lit(None).cast("string")
    slot = lambda x, c: F.struct(_edited(x, c, nothing).alias("line"), F.when(c == 3, "!").when(c == 4, "?").alias("gap"))
    changed = [_edited(F.col(c), _code(name, c), F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select("doc_id", *changed, F.zip_with(lines, codes, slot).alias("slots"), (_code(name, "row") == 0).alias("dropped"))


def added(docs: DataFrame, name: str, step: int) -> DataFrame:
    """The rows that the branch adds."""
    mark = F.when(_code(name, "row") == 3, "!").when(_code(name, "row") == 4, "?")
    return docs.where(mark.isNotNull()).select((-step - F.col("doc_id")).alias("doc_id"), "lang", "source", lines_of(mark).alias("slots"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """Ids are non-negative, so that those of added rows are others; documents without one are returned as they are, without changes. Kept and added rows
    have no id in common, so they are merged apart: all versions of kept rows come from one exchange of the documents."""
    columns = ["lang", "source"]
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = common.table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text").select(F.col("doc_id").cast("long"), *map(empty, ("lang", "source", "text")))
    docs = unique(docs, "doc_id")

    def versions(rows: DataFrame) -> list[DataFrame]:
        base = rows.select("doc_id", *columns, lines_of(F.col("text")).alias("slots"), F.lit(False).alias("dropped"))
        return [base, branch(rows, "L"), branch(rows, "R")]

    base, *_ = kept = versions(docs)
    merged = merge(kept, "doc_id", columns, dropped="dropped", dealt=versions(docs.repartition("doc_id")))
    none = spark.createDataFrame([], base.drop("dropped").schema)
    new = merge([none, added(docs, "L", 1), added(docs, "R", 2)], "doc_id", columns)
    return merged.unionByName(new).select("doc_id", *columns, F.when(F.col("present"), F.sha2(text_of(F.col("slots")), 256)).alias("text_sha256"), *COUNTS)
