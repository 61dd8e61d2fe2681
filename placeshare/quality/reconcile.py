"""Cell-by-cell comparison of two versions of a metric."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeshare.plans.registry import METRICS

# Kinds of issue.
ONLY_LEFT = "row_only_in_sql"
ONLY_RIGHT = "row_missing_in_sql"
MISMATCH = "value_mismatch"

ISSUE_COLUMNS = (
    "metric", "key", "column", "sut_value", "ref_value", "sut_text", "ref_text", "kind",
)


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def normalize_frame(df: DataFrame) -> DataFrame:
    """Numbers and flags as double, everything else as text; missing is null."""
    columns = []
    for field in df.schema:
        name = _quoted(field.name)
        kind = "double" if _is_number(field.dataType) else "string"
        value = f"cast({name} as int)" if isinstance(field.dataType, T.BooleanType) else name
        columns.append(f"cast({value} as {kind}) as {name}")
    return df.selectExpr(*columns)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _same_number(a: str, b: str, rtol: float, atol: float) -> str:
    """Two missing numbers agree, one does not; else within the absolute plus relative tolerance."""
    gone_a, gone_b = f"({a} is null or isnan({a}))", f"({b} is null or isnan({b}))"
    near = f"{a} = {b} or abs({a} - {b}) <= {atol!r}D + {rtol!r}D * abs({b})"
    return f"case when {gone_a} or {gone_b} then {gone_a} and {gone_b} else {near} end"


def _issue(
    column: str, kind: str, numbers: tuple[str, str] | None = None, texts: tuple[str, str] | None = None
) -> str:
    sut, ref = numbers or ("cast(null as double)",) * 2
    sut_text, ref_text = texts or ("cast(null as string)",) * 2
    return (
        f"named_struct('column', {column}, 'sut_value', {sut}, 'ref_value', {ref}, "
        f"'sut_text', {sut_text}, 'ref_text', {ref_text}, 'kind', {kind})"
    )


def reconcile_frames(
    name: str,
    sut: DataFrame,
    ref: DataFrame,
    keys: Sequence[str],
    rtol: float = 1e-9,
    atol: float = 1e-9,
    by: Sequence[str] = (),
) -> DataFrame:
    """Issues between two frames: one full outer join, then the differing cells as rows.

    ``by`` names columns (such as a defect id) that belong to the key but not to its text.
    """
    lacking = [c for c in sut.columns if c not in ref.columns]
    if lacking:
        raise KeyError(f"reference for {name} lacks columns {lacking}")
    joined_on = [*by, *keys]
    values = [c for c in sut.columns if c not in joined_on]
    numeric = {f.name: _is_number(f.dataType) for f in sut.schema}

    def side(df: DataFrame, short: str) -> DataFrame:
        prefixed = [f"{_quoted(c)} as {_quoted(f'{short}_{c}')}" for c in (*joined_on, *values)]
        return normalize_frame(df.select(*sut.columns)).selectExpr(
            *prefixed, f"true as in_{short}"
        )

    def cell(short: str, column: str) -> str:
        return _quoted(f"{short}_{column}")

    merged = side(sut, "a").join(
        side(ref, "b"),
        F.expr(" and ".join(f"{cell('a', k)} <=> {cell('b', k)}" for k in joined_on)),
        "full",
    )

    def key(k: str) -> str:
        return f"if(in_a, {cell('a', k)}, {cell('b', k)})"

    one_sided = "(in_a is null or in_b is null)"
    found = [f"if({one_sided}, " + _issue(
        "cast(null as string)", f"if(in_b is null, '{ONLY_LEFT}', '{ONLY_RIGHT}')"
    ) + ", null)"]
    for c in values:
        a, b = cell("a", c), cell("b", c)
        pair = (a, b)
        same = _same_number(a, b, rtol, atol) if numeric[c] else f"{a} <=> {b}"
        issue = _issue(
            "'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'", f"'{MISMATCH}'", pair if numeric[c] else None, None if numeric[c] else pair
        )
        found.append(f"if(not {one_sided} and not ({same}), {issue}, null)")

    def shown(k: str) -> str:
        text = f"cast({key(k)} as string)"
        if numeric[k]:
            whole = f"floor({key(k)})"
            text = f"if({key(k)} = {whole}, cast({whole} as string), {text})"
        return f"concat('{k}=', coalesce({text}, 'null'))"

    return merged.selectExpr(
        *[f"{key(k)} as {_quoted(k)}" for k in by],
        f"'{name}' as metric",
        f"concat_ws('|', {', '.join(shown(k) for k in keys)}) as key",
        f"inline(array_compact(array({', '.join(found)})))",
    )


def reconcile_metric(
    name: str, sut: DataFrame, ref: DataFrame, rtol: float = 1e-9, atol: float = 1e-9,
    by: Sequence[str] = (),
) -> DataFrame:
    return reconcile_frames(name, sut, ref, METRICS[name].keys, rtol, atol, by)


def reconcile_all(
    sut: Mapping[str, DataFrame], ref: Mapping[str, DataFrame], by: Sequence[str] = ()
) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [reconcile_metric(name, sut[name], ref[name], by=by) for name in METRICS if name in sut],
    )


def reconcile_summary(
    sut: Mapping[str, DataFrame], ref: Mapping[str, DataFrame], issues: DataFrame | None = None
) -> DataFrame:
    """Per metric: rows on each side, cells compared, mismatches, status."""
    issues = reconcile_all(sut, ref) if issues is None else issues
    rows, widths = [], {}
    for name, metric in METRICS.items():
        widths[name] = len(sut[name].columns) - len(metric.keys)
        rows.append(sut[name].selectExpr(f"'{name}' as metric", "1 as a", "0 as b"))
        rows.append(ref[name].selectExpr(f"'{name}' as metric", "0 as a", "1 as b"))
    counted = reduce(DataFrame.unionAll, rows).groupBy("metric").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")
    )
    names = sut[next(iter(METRICS))].sparkSession.range(1).selectExpr("inline(array({}))".format(
        ", ".join(f"struct('{n}' as metric, {w} as width)" for n, w in widths.items())
    ))
    sizes = names.join(counted, "metric", "left").selectExpr(
        "metric", "coalesce(a, 0L) as rows_sql", "coalesce(b, 0L) as rows_reference",
        "coalesce(a, 0L) * width as cells_compared",
    )
    bad = issues.groupBy("metric").agg(F.count(F.lit(1)).alias("mismatches"))
    return (
        sizes.join(bad, "metric", "left")
        .withColumn("mismatches", F.coalesce("mismatches", F.lit(0)).cast("long"))
        .withColumn("status", F.when(F.col("mismatches") == 0, "match").otherwise("MISMATCH"))
    )
