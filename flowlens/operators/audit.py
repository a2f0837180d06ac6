"""Schema audit over many files at once: which model can read which file, and how each feature is had."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import schemas as SC
from flowlens.functions import scalars as S
from flowlens.plans.mapping import name_rules

MODELS = ["cicids", "unsw", "generalized"]


def name_rule_table(spark) -> DataFrame:
    """All naming rules as a table; its size is fixed by the schemas (about 1,600 rows), so it may be broadcast."""
    rows = [(m, *rule) for m in MODELS for rule in name_rules(m)]
    return spark.createDataFrame(
        rows, "model string, target string, priority int, how string, kind string, key string"
    )


def name_candidates(headers: DataFrame) -> DataFrame:
    """Per distinct column name the features it can provide. Names repeat over files, so rules meet each name once."""
    names = headers.select(F.trim("column").alias("column")).distinct()
    forms = F.array(
        F.struct(F.lit("exact").alias("kind"), F.col("column").alias("key")),
        F.struct(F.lit("lower").alias("kind"), F.lower("column").alias("key")),
        F.struct(F.lit("token").alias("kind"), S.normalize_token(F.col("column")).alias("key")),
    )
    usable = names.where(~F.lower("column").isin(*sorted(SC.LABEL_NAMES)))
    cells = usable.select("column", F.inline(forms))
    found = cells.join(F.broadcast(name_rule_table(headers.sparkSession)), ["kind", "key"])
    best = found.groupBy("column", "model", "target").agg(F.min(F.struct("priority", "how")).alias("b"))
    # a name meets a handful of rules at most
    return best.groupBy("column").agg(F.collect_list(F.struct(
        "model", "target", F.col("b")["priority"].alias("priority"), F.col("b")["how"].alias("how")
    )).alias("candidates"))


def resolve_headers(headers: DataFrame) -> DataFrame:
    """``headers(file, position, column)`` to one row per (file, model) with ``sources``: target -> (column, how).

    Of several columns with the same folded name the last one counts.
    """
    cells = headers.select("file", "position", F.trim("column").alias("column"))
    found = cells.join(name_candidates(headers), "column", "left").select(
        "file", "position", "column", F.inline_outer("candidates")
    )
    # at most (columns of one file) x (features per name) entries; one shuffle by file
    entry = F.when(F.col("target").isNotNull(), F.struct(
        "model", "target", "priority", (-F.col("position")).alias("last"), "column", "how"
    ))
    per_file = found.groupBy("file").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    each = per_file.select("file", "entries", F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model")).select(
        "file", "model", F.filter("entries", lambda e: e["model"] == F.col("model")).alias("entries")
    )

    def best_of_target(e: Column, i: Column) -> Column:
        before = F.get(F.col("entries"), i - 1)
        return before.isNull() | (before["target"] != e["target"])

    sources = F.transform(
        F.filter("entries", best_of_target),
        lambda e: F.struct(e["target"], F.struct(e["column"].alias("column"), e["how"].alias("how"))),
    )
    return each.select("file", "model", F.map_from_entries(sources).alias("sources"))


def can_derive(model: Column, target: Column, resolved: Column) -> Column:
    """Whether some base set of the target is fully resolved."""
    rules = []
    for m in MODELS:
        for t, sets in SC.DERIVABLE[m].items():
            rules += [F.lit(f"{m}|{t}"), F.array(*[F.array(*[F.lit(b) for b in s]) for s in sets])]
    sets = F.try_element_at(F.create_map(*rules), F.concat_ws("|", model, target))
    have = F.exists(sets, lambda s: F.forall(s, lambda b: F.array_contains(resolved, b)))
    return F.coalesce(have, F.lit(False))


def mapping_rows(headers: DataFrame) -> DataFrame:
    """One row per (file, model, required feature): where it comes from and how."""
    required = F.create_map(*[
        x for m in MODELS for x in (F.lit(m), F.array(*[F.lit(f) for f in SC.FEATURES[m]]))
    ])
    rows = resolve_headers(headers).select(
        "file", "model", "sources", F.posexplode(required[F.col("model")]).alias("feature_no", "target_feature")
    )
    hit = F.try_element_at("sources", F.col("target_feature"))
    derived = can_derive(F.col("model"), F.col("target_feature"), F.map_keys("sources"))
    how = F.when(hit.isNotNull(), hit["how"]).when(derived, "DERIVED_CALCULATION").otherwise("MISSING")
    return rows.select(
        "file", "model", "feature_no", "target_feature", hit["column"].alias("source_feature"),
        how.alias("transform_type"), F.when(how == "MISSING", "missing").otherwise("mapped").alias("status"),
    )


def compatibility(headers: DataFrame) -> DataFrame:
    """One row per (file, model): counts by kind of mapping, match percentage, status."""
    rows = resolve_headers(headers)
    sizes = F.create_map(*[x for m in MODELS for x in (F.lit(m), F.lit(len(SC.FEATURES[m])))])
    formulas = F.create_map(*[
        x for m in MODELS for x in (F.lit(m), F.array(*[F.lit(t) for t in SC.DERIVABLE[m]]))
    ])
    have = F.map_keys("sources")
    ways = F.map_values("sources")
    direct = F.size(F.filter(ways, lambda w: w["how"] != "ALIAS_MAPPED"))
    derived = F.filter(
        formulas[F.col("model")],
        lambda t: ~F.array_contains(have, t) & can_derive(F.col("model"), t, have),
    )
    counts = rows.select(
        "file", "model", sizes[F.col("model")].cast("long").alias("total_required"), direct.cast("long").alias("matched"),
        (F.size("sources") - direct).cast("long").alias("transformed"), F.size(derived).cast("long").alias("derived"),
    ).withColumn("missing", F.col("total_required") - F.col("matched") - F.col("transformed") - F.col("derived"))
    total = F.col("total_required")
    return counts.withColumns({
        "match_percentage": F.round((total - F.col("missing")) * 100.0 / total, 1),
        "is_inferable": F.col("missing") == 0,
        "status": F.when(F.col("matched") == total, SC.EXACT_MATCH)
        .when(F.col("missing") == 0, SC.TRANSFORMABLE).otherwise(SC.UNSUPPORTED),
    })


def choose_schema(headers: DataFrame, requested: str | None = None) -> DataFrame:
    """One row per file: the schema to use, its status, and texts that explain it.

    A requested dataset is taken or refused; otherwise the first inferable schema in the order of ``MODELS``
    wins, else the best match.
    """
    rows = compatibility(headers)
    order = F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("model"))
    missing = F.map_from_entries(F.collect_list(F.struct("model", "missing")))
    asked = F.lit(True) if requested is None else F.col("model") == SC.model_of(requested)
    rank = F.struct(
        asked.alias("asked"), F.col("is_inferable").alias("fits"),
        F.when(F.col("is_inferable"), 0.0).otherwise(F.col("match_percentage")).alias("match"),
        (-order).alias("order"),
    )
    best = F.max(F.struct(rank.alias("rank"), "model", "status", "match_percentage", "is_inferable", "transformed", "derived"))
    chosen = rows.groupBy("file").agg(best.alias("b"), missing.alias("missing"))
    b, status = F.col("b"), F.col("b")["status"]
    names = [x for m in MODELS for x in (F.lit(f"{m}|{SC.EXACT_MATCH}"), F.lit(SC.SCHEMA_NAME[m]))]
    names += [x for m in MODELS for x in (F.lit(f"{m}|{SC.TRANSFORMABLE}"), F.lit(SC.ADAPTED_NAME[m]))]
    schema = F.coalesce(
        F.try_element_at(F.create_map(*names), F.concat_ws("|", b["model"], status)), F.lit("Partial / Custom Schema")
    )
    gaps = {k: F.col("missing")[F.lit(m)] for k, m in zip("cug", MODELS)}
    explanation = (
        F.when(status == SC.EXACT_MATCH, _fill(SC.EXPLAIN_EXACT, schema=schema))
        .when(status == SC.TRANSFORMABLE, _fill(SC.EXPLAIN_ADAPTED, schema=schema))
        .otherwise(_fill(SC.EXPLAIN_UNSUPPORTED, **gaps))
    )
    action = (
        F.when(status == SC.EXACT_MATCH, SC.ACTION_EXACT)
        .when(status == SC.TRANSFORMABLE, _fill(SC.ACTION_ADAPTED, n=b["transformed"] + b["derived"]))
        .otherwise(SC.ACTION_UNSUPPORTED)
    )
    return chosen.select(
        "file", b["model"].alias("model"), schema.alias("detected_schema"), status.alias("status"),
        b["match_percentage"].alias("match_percentage"), b["is_inferable"].alias("is_inferable"),
        explanation.alias("explanation"), action.alias("recommended_action"),
    )


def extra_columns(headers: DataFrame, model: str, limit: int | None = None) -> DataFrame:
    """Per file its feature columns that ``model`` does not use, in file order (the first ``limit`` if given)."""
    used = resolve_headers(headers).where(F.col("model") == model).select(
        "file", F.transform(F.map_values("sources"), lambda s: s["column"]).alias("used")
    )
    name = F.trim("column")
    cells = headers.where(~F.lower(name).isin(*sorted(SC.LABEL_NAMES))).groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("position", name.alias("column")))).alias("cells")
    )
    rest = F.filter(F.transform("cells", lambda c: c["column"]), lambda c: ~F.array_contains(F.col("used"), c))
    return cells.join(used, "file").select("file", (rest if limit is None else F.slice(rest, 1, limit)).alias("extra_features"))


def _fill(template: str, **values: Column) -> Column:
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])
