"""Files whose fields drift: one consistent table, and each change from one file to the next.

Rows are read as (path, type, raw value) by the engine's own variant type, statistics are gathered by file
and path, and the table is then projected with one type per column, counting the casts that fail.

Defined cases: a payload that is null, not JSON or not an object has no fields and counts as rejected; a
field is in a file if a row has its key, null or not; its type there is that of most of its values (of
equally many the first by name), unknown if all are null, and an unknown type is never a change of type;
files of a feed are ordered by number, then by id. Repeated rows change nothing. Empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelorus.session import cut, stored

#: Distinct field names that a feed family may have; names, not rows, reach the driver.
MAX_NAMES = 10_000

_KIND = """
    case when t = 'VOID' then null when t = 'STRING' then 'string' when t = 'BOOLEAN' then 'boolean'
         when t like 'ARRAY%' then 'array' when t like 'OBJECT%' then 'object'
         when t in ('DATE', 'BINARY', 'UUID') or t like 'TIMESTAMP%' then 'string' else 'number' end
"""


def field_values(rows: DataFrame) -> DataFrame:
    """One row per row and top-level key: feed, file_no, file_id, row_id, area, field, kind, raw.

    rows: row_id, file_id, feed, file_no, payload. kind is string, number, boolean, array, object, or null
    for JSON null; raw is the value as JSON with object keys in order, null for JSON null.
    """
    spark = rows.sparkSession
    parsed = rows.select("row_id", "file_id", "feed", "file_no", F.try_parse_json("payload").alias("v"))
    parsed = parsed.withColumn("area", F.try_variant_get("v", "$.id", "string"))
    parsed = parsed.where(F.schema_of_variant("v").startswith("OBJECT"))
    spread = parsed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return (
        spread.where(F.col("key").isNotNull())
        .withColumn("t", F.schema_of_variant("value"))
        .withColumn("kind", F.expr(_KIND))
        .select(
            "feed", "file_no", "file_id", "row_id", "area", F.col("key").alias("field"), "kind",
            F.when(F.col("kind").isNotNull(), F.to_json("value")).alias("raw"),
        )
    )


def nested_paths(rows: DataFrame, depth: int = 6) -> DataFrame:
    """Path statistics by file, however deep: feed, file_no, file_id, path, kind, n.

    `depth` levels are planned at once; if objects or arrays are left below them, these are written and gone on from.
    """
    spark = rows.sparkSession
    level = rows.select("file_id", "feed", "file_no", F.try_parse_json("payload").alias("v"), F.lit("$").alias("path"))
    level = level.where(F.schema_of_variant("v").startswith("OBJECT"))
    found = None
    while True:
        for _ in range(depth):
            spread = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
            step = F.coalesce(F.concat(F.lit("."), F.col("key")), F.lit("[*]"))
            spread = (
                spread.withColumn("path", F.concat("path", step)).withColumn("t", F.schema_of_variant("value"))
                .withColumn("kind", F.expr(_KIND)).select("feed", "file_no", "file_id", "path", "kind", F.col("value").alias("v"))
            )
            counted = spread.groupBy("feed", "file_no", "file_id", "path", "kind").agg(F.count("*").alias("n"))
            found = counted if found is None else found.unionByName(counted)
            level = spread.where(F.col("kind").isin("object", "array")).drop("kind")
        level = cut(level)
        if level.isEmpty():
            return found


def file_order(rows: DataFrame) -> DataFrame:
    """Each file with the file before it in its feed: feed, file_id, prev_id."""
    files = rows.select("feed", "file_no", "file_id").distinct()
    before = Window.partitionBy("feed").orderBy("file_no", "file_id")
    return files.withColumn("prev_id", F.lag("file_id").over(before)).select("feed", "file_id", "prev_id")


def file_fields(values: DataFrame) -> DataFrame:
    """file_id, field, kind: the fields of each file and their type there."""
    counted = values.groupBy("file_id", "field", "kind").agg(F.count("*").alias("n"))
    rank = F.struct(F.when(F.col("kind").isNotNull(), F.col("n")).otherwise(-1).alias("n"), F.col("kind").isNotNull().alias("known"))
    best = Window.partitionBy("file_id", "field").orderBy(rank.desc(), F.col("kind"))
    return counted.withColumn("r", F.row_number().over(best)).where("r = 1").select("file_id", "field", "kind")


def field_changes(rows: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """file_id, change, old_field, new_field: added, removed, renamed and retyped fields.

    A field that goes and one that comes are one renamed field if, over the areas that both files hold,
    each value of either equals the other's, and at least one does. Of several such partners the one with
    the likest name counts, if the choice is mutual. values: those of the rows, if they are stored already.
    """
    values = stored(field_values(rows), "field-values") if values is None else values
    order = file_order(rows).where(F.col("prev_id").isNotNull())
    fields = file_fields(values)
    now = fields.join(order.select("file_id"), "file_id").select("file_id", "field", F.col("kind").alias("new_kind"), F.lit(1).alias("in_new"))
    then = (
        fields.withColumnRenamed("file_id", "prev_id").join(order.select("file_id", "prev_id"), "prev_id")
        .select("file_id", "field", F.col("kind").alias("old_kind"), F.lit(1).alias("in_old"))
    )
    both = cut(now.join(then, ["file_id", "field"], "full").where(F.col("field") != "id"))
    added = both.where("in_old is null").select("file_id", F.col("field").alias("new_field"))
    removed = both.where("in_new is null").select("file_id", F.col("field").alias("old_field"))
    retyped = both.where("in_old = 1 and in_new = 1 and old_kind <> new_kind").select(
        "file_id", F.lit("retyped").alias("change"), F.col("field").alias("old_field"), F.col("field").alias("new_field")
    )
    renamed = cut(_renamed(values, order, added, removed))
    changed = renamed.select("file_id", F.lit("renamed").alias("change"), "old_field", "new_field")
    came = added.join(renamed.select("file_id", "new_field"), ["file_id", "new_field"], "left_anti")
    went = removed.join(renamed.select("file_id", "old_field"), ["file_id", "old_field"], "left_anti")
    return (
        retyped.unionByName(changed)
        .unionByName(came.select("file_id", F.lit("added").alias("change"), F.lit("").alias("old_field"), "new_field"))
        .unionByName(went.select("file_id", F.lit("removed").alias("change"), "old_field", F.lit("").alias("new_field")))
    )


def _renamed(values: DataFrame, order: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    known = values.where(F.col("area").isNotNull())
    areas = known.select("file_id", "area").distinct()
    links = order.select("file_id", "prev_id")
    earlier = areas.withColumnRenamed("file_id", "prev_id").join(links, "prev_id").select("file_id", "area")
    common = areas.join(earlier, ["file_id", "area"])
    filled = known.where(F.col("raw").isNotNull()).select("file_id", "area", "field", "raw").distinct()
    new = filled.withColumnRenamed("field", "new_field").join(added, ["file_id", "new_field"]).join(common, ["file_id", "area"])
    old = (
        filled.withColumnRenamed("file_id", "prev_id").join(links, "prev_id").drop("prev_id")
        .withColumnRenamed("field", "old_field").join(removed, ["file_id", "old_field"]).join(common, ["file_id", "area"])
    )
    same = old.join(new, ["file_id", "area", "raw"]).groupBy("file_id", "old_field", "new_field").agg(F.count("*").alias("same"))
    of_old = old.groupBy("file_id", "old_field").agg(F.count("*").alias("n_old"))
    of_new = new.groupBy("file_id", "new_field").agg(F.count("*").alias("n_new"))
    pairs = same.join(of_old, ["file_id", "old_field"]).join(of_new, ["file_id", "new_field"])
    pairs = pairs.where("same = n_old and same = n_new").withColumn("gap", F.levenshtein("old_field", "new_field"))
    by_old = Window.partitionBy("file_id", "old_field").orderBy("gap", "new_field")
    by_new = Window.partitionBy("file_id", "new_field").orderBy("gap", "old_field")
    pairs = pairs.withColumn("ro", F.row_number().over(by_old)).withColumn("rn", F.row_number().over(by_new))
    return pairs.where("ro = 1 and rn = 1").select("file_id", "old_field", "new_field", "same")


def column_names(changes: DataFrame, values: DataFrame) -> tuple[dict[str, list[str]], dict[str, str]]:
    """Columns of the consistent table: all names each has had, and the type of each.

    Names joined by a renaming are one column, called by the name most rows have. Only names and counts
    reach the driver, at most MAX_NAMES of them.
    """
    whole = F.col("raw").try_cast("bigint").isNotNull() & ~F.col("raw").rlike("[.eE]")
    counts = values.groupBy("field", "kind").agg(F.count("*").alias("n"), F.count_if((F.col("kind") == "number") & ~whole).alias("parts")).limit(MAX_NAMES * 6 + 1).collect()
    if len(counts) > MAX_NAMES * 6:
        raise ValueError(f"more than {MAX_NAMES} field names")
    total: dict[str, int] = {}
    kinds: dict[str, dict[str, int]] = {}
    broken: dict[str, int] = {}
    for r in counts:
        broken[r["field"]] = broken.get(r["field"], 0) + r["parts"]
        total[r["field"]] = total.get(r["field"], 0) + r["n"]
        if r["kind"]:
            kinds.setdefault(r["field"], {})[r["kind"]] = r["n"]
    up = {f: f for f in total}

    def top(f: str) -> str:
        while up[f] != f:
            f = up[f]
        return f

    pairs = changes.where("change = 'renamed'").groupBy("old_field", "new_field").count().limit(MAX_NAMES * 10 + 1).collect()
    if len(pairs) > MAX_NAMES * 10:
        raise ValueError(f"more than {MAX_NAMES * 10} pairs of names in renamings")
    for r in sorted(pairs, key=lambda r: (r["old_field"], r["new_field"])):
        if r["old_field"] in up and r["new_field"] in up:
            up[top(r["old_field"])] = top(r["new_field"])
    groups: dict[str, list[str]] = {}
    for f in sorted(total, key=lambda f: (-total[f], f)):
        groups.setdefault(top(f), []).append(f)
    columns = {names[0]: names for names in groups.values()}
    typed: dict[str, str] = {}
    for name, names in columns.items():
        scalar = {k: sum(kinds.get(f, {}).get(k, 0) for f in names) for k in ("boolean", "number", "string")}
        best = max(scalar, key=lambda k: scalar[k])
        number = "double" if any(broken.get(f) for f in names) else "bigint"
        typed[name] = {"boolean": "boolean", "number": number}.get(best, "string") if scalar[best] else "string"
    return columns, typed


def consistent_table(rows: DataFrame, columns: dict[str, list[str]], typed: dict[str, str]) -> DataFrame:
    """row_id, feed, file_no, file_id, the columns, and failed_casts (names of columns that didn't fit).

    Values are taken from whichever name a row has them under; a value wrapped in a list of one or in an
    object of one key is unwrapped; longer ones stay as JSON, or fail the cast. Numbers that are all whole are
    bigint; where others are among them, a whole number that a double can't hold fails too. No shuffle.
    """
    body = F.from_json("payload", "map<string,string>")
    out = rows.select("row_id", "feed", "file_no", "file_id", body.alias("m"))
    made, failed = [], []
    for name, names in columns.items():
        raw = F.coalesce(*[F.col("m")[n] for n in names])
        inner = F.when(F.json_array_length(raw) == 1, F.get_json_object(raw, "$[0]")).when(
            F.size(F.json_object_keys(raw)) == 1, F.get(F.map_values(F.from_json(raw, "map<string,string>")), F.lit(0))
        )
        plain = F.when(raw.rlike(r"^\s*[\[{]"), F.coalesce(inner, raw)).otherwise(raw)
        value = plain if typed[name] == "string" else plain.try_cast(typed[name])
        made.append(value.alias(name))
        bad = value.isNull()
        if typed[name] == "double":
            exact = plain.try_cast("decimal(38,0)")
            bad |= F.coalesce(plain.rlike(r"^\s*-?\d{16,}\s*$") & (exact.isNull() | (value.cast("decimal(38,0)") != exact)), F.lit(False))
        failed.append(F.when(plain.isNotNull() & bad, F.lit(name)))
    if not made:
        return out.drop("m").withColumn("failed_casts", F.array().cast("array<string>"))
    return out.select("row_id", "feed", "file_no", "file_id", *made, F.array_compact(F.array(*failed)).alias("failed_casts"))
