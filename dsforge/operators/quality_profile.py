"""Column profile of every load of a table, and the loads whose columns are faulty (problem 2).

Method: exact base aggregates (rows, missing, distinct, least and greatest value, values outside their range, forms of values) for every load
and column, and a classifier two-sample test: distributed logistic regression learns to tell each load from all others by the binned
values of all compared columns together. Two folds are cross-fitted: an item's rows, copies included, lie in one fold, and every row is scored by the weights of the other fold.
A column's values have changed if, on the load's unseen rows that have one, (1) the whole model tells the load from the others, (2) the column's share of the score does so alone, and
(3) leaving the column out (ablation) costs at least ``DROP`` of the area under the curve, or the rest still tells the load apart, so that other changed columns hide the loss, and the column adds
``GAIN`` to the log-odds.
Weights are joint: a column that merely goes along with a changed one gets none of the credit. Missing values say nothing: they have a bin of their own in the fit and none in the score.

Scale: base aggregates are one grouping by load, and one by (load, column, value) for the columns whose values are looked at, with map-side combine. The regression is fitted in ``STEPS``
passes from zero on at most about ``FIT_ROWS`` rows of each load, drawn by hash (a bounded sample of labelled rows); counts, bins and scores cover all rows. A pass sends one partial
gradient (bins x loads) per task through a grouping; scores are added up per task as histograms. Work is rows x loads of numpy in the one scoring pass, for the loads that a column's exact counts
set apart. Nothing but counts by (load, column, bin) reaches the driver. A load that holds a third of all rows is only added up, never gathered.

Defined results: null and the empty string are missing; a load of null is left out; values of unusual form or outside their range count as ``pattern`` or ``range``
and take no part in ``distribution``; a form is usual if at least half of a column's loads have it, and a load is at fault in ``pattern`` if it has more other values than loads usually have (none, as a rule);
loads with fewer than ``MIN_VALUES`` present values of a column are not compared in it; with fewer than three loads nothing is compared; a column's values beyond its ``TOP`` most frequent share ``TAIL`` bins by hash;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
import statistics
import string
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dsforge.session import written

#: Faults: difference in the share of missing values; difference in the share of repeated values; tolerated error of a reported coverage.
NULLS, REPEATS, COVERAGE = 0.17, 0.10, 0.001
MIN_VALUES, BINS, TOP, TAIL = 30, 20, 40, 24
#: The fit: rows of each load, passes, step and its greatest length, and penalty on squared weights.
FIT_ROWS, STEPS, RATE, STRIDE, L2 = 4000, 6, 0.8, 2.0, 0.002
#: Told apart: at least this area under the curve, and so many standard errors over one half. What ablation must cost in area; what a column must add to the log-odds on average.
AREA, ERRORS, DROP, GAIN = 0.58, 4.0, 0.01, 0.3
CELLS, REACH = 256, 8.0
NUMERIC = ("double", "float", "long", "integer", "short", "byte", "decimal")


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def form(c: Column) -> Column:
    """A value's form: digits as 9, letters as A or a, runs of white space as one space."""
    plain = F.translate(c, string.digits + string.ascii_uppercase + string.ascii_lowercase, "9" * 10 + "A" * 26 + "a" * 26)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\p{Nd}", "9"), r"\p{Lu}", "A"), r"\p{Ll}", "a"), r"\s+", " ")
    return F.when(plain.rlike(r"^[\x21-\x7e]*$"), plain).otherwise(rest)


def form_of(value: str) -> str:
    """The same in Python."""
    kinds = {"Nd": "9", "Lu": "A", "Ll": "a"}
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", "".join(kinds.get(unicodedata.category(c), c) for c in value))


def long_values(df: DataFrame, load_col: str, columns: list[str]) -> DataFrame:
    """(_load, _column, _value) of every row and column."""
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    return df.where(F.col(f"`{load_col}`").isNotNull()).select(F.col(f"`{load_col}`").alias("_load"), F.explode(cells).alias("x")).select("_load", F.col("x.c").alias("_column"), F.col("x.v").alias("_value"))


def value_counts(values: DataFrame) -> DataFrame:
    """(_load, _column, _value, _n): exact counts of every distinct value."""
    return values.groupBy("_load", "_column", "_value").agg(F.count(F.lit(1)).alias("_n"))


def profile(counts: DataFrame, numeric_columns: list[str] = ()) -> DataFrame:
    """One row per load and column; values are distinct in ``counts``, so they are counted, not compared again. Ranges are of numbers in numeric columns, else of texts."""
    there = _present(F.col("_value"))
    number = F.col("_column").isin(*numeric_columns)
    value = F.when(there & number, F.expr("try_cast(_value as double)"))
    return counts.groupBy("_load", "_column").agg(
        F.sum("_n").alias("n_rows"),
        F.sum(F.when(F.col("_value").isNotNull(), F.col("_n")).otherwise(0)).alias("n_not_null"),
        F.sum(F.when(there, F.col("_n")).otherwise(0)).alias("n_present"),
        F.sum(F.when(there, 1).otherwise(0)).alias("n_unique"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.min(F.when(there & ~number, F.col("_value"))).alias("min_text"),
        F.max(F.when(there & ~number, F.col("_value"))).alias("max_text"),
    )


def _bounded(df: DataFrame, columns: list[str], bounds: DataFrame | None, group_col: str | None) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with their group's bounds, and for each numeric column whether its value lies outside."""
    numeric = [f.name for f in df.schema if f.name in columns and f.dataType.typeName() in NUMERIC]
    if bounds is None or not group_col or not numeric:
        return df, {}
    # one small row per group with the bounds of all its columns; it grows with the schema, not with the data
    wide = bounds.where(F.col("name").isin(*numeric)).groupBy(F.col(f"`{group_col}`").cast("string").alias("_group")).agg(
        *[F.max(F.when(F.col("name") == c, F.col(x))).alias(f"_{x}{i}") for i, c in enumerate(numeric) for x in ("min_value", "max_value")]
    )
    rows = df.withColumn("_group", F.col(f"`{group_col}`").cast("string")).join(wide, "_group", "left")
    return rows, {c: F.coalesce((F.col(f"`{c}`") < F.col(f"_min_value{i}")) | (F.col(f"`{c}`") > F.col(f"_max_value{i}")), F.lit(False)) for i, c in enumerate(numeric)}


def load_counts(df: DataFrame, columns: list[str], load_col: str, bounds: DataFrame | None = None, group_col: str | None = None) -> DataFrame:
    """(_load, _rows, and for column i the present values p<i> and those outside o<i>): one grouping by load, nothing but sums."""
    rows, outside = _bounded(df.where(F.col(f"`{load_col}`").isNotNull()), columns, bounds, group_col)
    texts = {f.name for f in df.schema if f.dataType.typeName() == "string"}
    sums = [F.sum((_present(F.col(f"`{c}`")) if c in texts else F.col(f"`{c}`").isNotNull()).cast("int")).alias(f"p{i}") for i, c in enumerate(columns)]
    sums += [F.sum(outside[c].cast("int")).alias(f"o{i}") for i, c in enumerate(columns) if c in outside]
    return rows.groupBy(F.col(f"`{load_col}`").alias("_load")).agg(F.count(F.lit(1)).alias("_rows"), *sums)


def form_counts(counts: DataFrame, pattern_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Exact (_load, _column, _form, _n) of present values, and (_column, _form) of the usual forms: those that at least half of the column's loads have."""
    # values are read once; a row for each form of a load and column
    of_form = written(counts.where(F.col("_column").isin(*pattern_columns) & _present(F.col("_value"))).groupBy("_load", "_column", form(F.col("_value")).alias("_form")).agg(F.sum("_n").alias("_n")))
    loads = of_form.groupBy("_column").agg(F.countDistinct("_load").alias("_loads"))
    have = of_form.groupBy("_column", "_form").agg(F.count(F.lit(1)).alias("_have"))
    return of_form, have.join(F.broadcast(loads), "_column").where("_have * 2 >= _loads").select("_column", "_form")  # one row per column


def _median(values: list[float]) -> float:
    return statistics.median(values) if values else 0.0


def base_faults(per_load: list, columns: list[str], odd: dict[tuple, int], unique: dict[tuple, int]) -> list[tuple]:
    """(load, column, issue) of the faults that show in the base aggregates; the figures are one number per load and column."""
    out = []
    for i, c in enumerate(columns):
        missing = {r["_load"]: 1 - r[f"p{i}"] / r["_rows"] for r in per_load}
        usual = _median(list(missing.values()))
        out += [(x, c, "nulls") for x, m in missing.items() if abs(m - usual) > NULLS]
        out += [(r["_load"], c, "range") for r in per_load if f"o{i}" in r and r[f"o{i}"]]
        present = {r["_load"]: r[f"p{i}"] for r in per_load if r[f"p{i}"]}
        share = _median([odd.get((x, c), 0) / n for x, n in present.items()])
        out += [(x, c, "pattern") for x, n in present.items() if (k := odd.get((x, c), 0)) > share * n + 3 * (share * n) ** 0.5]
        repeats = {x: 1 - unique[x, c] / n for x, n in present.items() if n >= MIN_VALUES and (x, c) in unique}
        usual = _median(list(repeats.values()))
        out += [(x, c, "distinct") for x, r in repeats.items() if r - usual > REPEATS]
    return out


def reported_faults(one: DataFrame, reports: DataFrame, load_col: str = "load_no") -> DataFrame:
    """Reports whose figures don't hold; ``one`` has _load, _column, n_rows and n_present."""
    own = reports.select(F.col(f"`{load_col}`").alias("_load"), F.col("column_name").alias("_column"), "n_non_null", "coverage")
    wrong = (F.col("n_non_null") != F.col("n_present")) | (F.abs(F.col("coverage") - F.col("n_present") / F.col("n_rows")) > COVERAGE)
    return own.join(one, ["_load", "_column"]).where(F.coalesce(wrong, F.lit(False))).select("_load", "_column", F.lit("reported").alias("issue")).distinct()


class Bins:
    """The bins of each compared column; the last of a column stands for a missing value."""

    def __init__(self, columns: list[str], edges: dict[str, list[float]], top: dict[str, list[str]], forms: dict[str, set[str]]):
        self.columns, self.edges, self.forms = columns, edges, forms
        self.top = {c: {v: i for i, v in enumerate(x)} for c, x in top.items()}
        self.sizes = [len(edges[c]) + 2 if c in edges else len(top[c]) + TAIL + 1 for c in columns]
        self.first = np.cumsum([0, *self.sizes])
        self.missing = self.first[1:] - 1

    def _text_bin(self, c: str, v: str | None) -> int:
        if not v or (c in self.forms and form_of(v) not in self.forms[c]):
            return -1
        return self.top[c].get(v, len(self.top[c]) + zlib.crc32(v.encode()) % TAIL)

    def code(self, batch) -> np.ndarray:
        """Rows x columns of bin numbers, counted over all columns."""
        out = np.empty((batch.num_rows, len(self.columns)), np.int32)
        for j, c in enumerate(self.columns):
            x = batch.column(c)
            if c in self.edges:
                v = x.to_numpy(zero_copy_only=False).astype(float)
                code = np.searchsorted(self.edges[c], v, "left")
                code[np.isnan(v)] = -1
            else:
                d = x.dictionary_encode()
                of = np.array([self._text_bin(c, v) for v in d.dictionary.to_pylist()] + [-1], np.int64)
                code = of[d.indices.fill_null(len(of) - 1).to_numpy(zero_copy_only=False)]
            out[:, j] = np.where(code < 0, self.missing[j], code + self.first[j])
        return out


def _bins(rows: DataFrame, counts: DataFrame, numeric: list[str], columns: list[str], usual: dict[str, set[str]]) -> Bins:
    """Quantiles of numbers and the most frequent texts, over all rows."""
    edges: dict[str, list[float]] = {}
    if numeric:
        got = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), [i / BINS for i in range(1, BINS)], 1000).alias(c) for c in numeric]).first()
        edges = {c: sorted(set(got[c] or [])) for c in numeric}
    texts = [c for c in columns if c not in numeric]
    top: dict[str, list[str]] = {c: [] for c in texts}
    if texts:
        total = counts.where(F.col("_column").isin(*texts) & _present(F.col("_value"))).groupBy("_column", "_value").agg(F.sum("_n").alias("_n"))
        # sorted and cut within each task first, so a column of many values never meets in one task
        ranked = total.withColumn("_r", F.row_number().over(Window.partitionBy("_column").orderBy(F.desc("_n"), "_value"))).where(F.col("_r") <= TOP)
        for r in ranked.orderBy("_column", "_r").collect():
            top[r._column].append(r._value)
    return Bins(columns, edges, top, usual)


def _area(up: np.ndarray, down: np.ndarray, score: np.ndarray) -> float:
    """Area under the curve of a score over bins, from the counts of both sides; ties count half."""
    order = np.argsort(score, kind="stable")
    s, u, d = score[order], up[order].astype(float), down[order].astype(float)
    if not u.sum() or not d.sum():
        return 0.5
    group = np.cumsum(np.concatenate([[0], (np.diff(s) > 1e-12).astype(int)]))
    u, d = np.bincount(group, u), np.bincount(group, d)
    below = np.cumsum(d) - d
    return float((u * (below + d / 2)).sum() / u.sum() / d.sum())


def _unpack(batch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Load, fold and bins of a batch of coded rows."""
    raw = b"".join(batch.column(2).to_pylist())
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.frombuffer(raw, np.int32).reshape(-1, width)


def _summed(df: DataFrame, run, size: int) -> np.ndarray:
    """Adds up the vectors that tasks give in sparse form."""

    def sparse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        whole = run(batches)
        used = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(whole[used], pa.float64())], names=["i", "g"])

    out = np.zeros(size)
    for r in df.mapInArrow(sparse, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).collect():
        out[r.i] = r.g
    return out


def _fit(sample: DataFrame, n: np.ndarray, bins: Bins, steps: int) -> np.ndarray:
    """Weights by (fold, bin, load) of one logistic regression per load against all others, both sides weighing the same; ``n`` has the sampled rows by (fold, load)."""
    width, loads = int(bins.first[-1]), n.shape[1]
    w, bias = np.zeros((2, width, loads)), np.zeros((2, loads))
    own_weight = (1 / np.maximum(n, 1)).astype(np.float32)
    other_weight = (1 / np.maximum(n.sum(1, keepdims=True) - n, 1)).astype(np.float32)
    size, columns = w.size, len(bins.columns)
    for _ in range(steps):
        shared = sample.sparkSession.sparkContext.broadcast((w.astype(np.float32), bias.astype(np.float32)))

        def gradient(batches: Iterator, shared=shared) -> np.ndarray:
            w, bias = shared.value
            g, h = np.zeros((2, width + 1, loads)), np.zeros((2, width + 1, loads))
            for batch in batches:
                own, fold, code = _unpack(batch, columns)
                for k in (0, 1):
                    o, c = own[fold == k], code[fold == k]
                    if not len(o):
                        continue
                    at = np.arange(len(o))
                    x = np.zeros((len(o), width + 1), np.float32)
                    x[at[:, None], c] = 1
                    x[:, width] = 1  # the bias
                    p = 1 / (1 + np.exp(-(x[:, :width] @ w[k] + bias[k])))
                    q = p * (1 - p)
                    d = -p * other_weight[k]
                    d[at, o] = (1 - p[at, o]) * own_weight[k, o]
                    s = q * other_weight[k]
                    s[at, o] = q[at, o] * own_weight[k, o]
                    g[k] += x.T @ d
                    h[k] += x.T @ s
            return np.concatenate([g.ravel(), h.ravel()])

        got = _summed(sample, gradient, 2 * (size + 2 * loads)).reshape(2, 2, width + 1, loads)
        g, h = got[0, :, :width] - L2 * w, got[1, :, :width] + L2
        step = g / h
        # each column moves its bins against each other, the level is left to the bias: else all columns would make up for the same error at once
        ends = bins.first[:-1]
        level = np.add.reduceat(g, ends, 1) / np.add.reduceat(h, ends, 1)
        w = w + RATE * np.clip(step - np.repeat(level, bins.sizes, 1), -STRIDE, STRIDE)
        bias = bias + RATE * np.clip(got[0, :, width] / (got[1, :, width] + L2), -STRIDE, STRIDE)
        shared.unpersist()
    return w


def told_apart(area: float, n: int) -> bool:
    return n >= MIN_VALUES and area >= max(AREA, 0.5 + ERRORS * (12 * n) ** -0.5)


def two_sample_test(coded: DataFrame, bins: Bins, loads: list, only_suspects: bool = False, steps: int | None = None) -> list[tuple]:
    """(load, column, n, area alone, area of all columns, area without the column, gain in log-odds), all of them on unseen rows that have a value of the column.

    ``coded`` has _load (place in ``loads``), _fold, _codes and _fit. ``only_suspects`` scores only loads that some column alone tells apart.
    """
    columns, width, first = bins.columns, int(bins.first[-1]), bins.first
    total = len(loads)
    if total < 3:
        return []

    def tally(batches: Iterator) -> np.ndarray:
        h, fitted = np.zeros(2 * total * width), np.zeros(2 * total)
        for batch in batches:
            own, fold, code = _unpack(batch, len(columns))
            flat = fold.astype(np.int64) * total + own
            for j in range(len(columns)):
                h += np.bincount(flat * width + code[:, j], minlength=len(h))
            fitted += np.bincount(flat[batch.column(3).to_numpy(zero_copy_only=False)], minlength=len(fitted))
        return np.concatenate([h, fitted])

    got = _summed(coded.select("_load", "_fold", "_codes", "_fit"), tally, 2 * total * (width + 1))
    h, n = got[: 2 * total * width].reshape(2, total, width).transpose(0, 2, 1), got[2 * total * width :].reshape(2, total)
    sample = coded.where("_fit").select("_load", "_fold", "_codes").persist()
    try:
        w = _fit(sample, n, bins, STEPS if steps is None else steps)
    finally:
        sample.unpersist()
    # a missing value says nothing: values speak by how far they are from the column's mean over all rows
    both = h.sum((0, 2))
    for j in range(len(columns)):
        cut = slice(first[j], bins.missing[j])
        w[:, cut] -= (both[cut, None] * w[:, cut]).sum(1, keepdims=True) / max(both[cut].sum(), 1)
        w[:, bins.missing[j]] = 0
    rest = h.sum(2, keepdims=True) - h
    alone, counts, gain = np.full((total, len(columns)), 0.5), np.zeros((total, len(columns)), int), np.zeros((total, len(columns)))
    for j in range(len(columns)):
        cut = slice(first[j], bins.missing[j])
        for x in range(total):
            parts = [(_area(h[k, cut, x], rest[k, cut, x], w[1 - k, cut, x]), h[k, cut, x].sum()) for k in (0, 1)]
            counts[x, j] = sum(m for _, m in parts)
            if counts[x, j]:
                alone[x, j] = sum(a * m for a, m in parts) / counts[x, j]
                gain[x, j] = sum((u @ v / max(u.sum(), 1) - d @ v / max(d.sum(), 1)) / 2 for u, d, v in ((h[k, cut, x], rest[k, cut, x], w[1 - k, cut, x]) for k in (0, 1)))
    asked = [x for x in range(total) if not only_suspects or any(told_apart(alone[x, j], counts[x, j]) for j in range(len(columns)))]
    if not asked:
        return []
    shared = coded.sparkSession.sparkContext.broadcast(w[:, :, asked].astype(np.float32))
    place = np.full(total, -1)
    place[asked] = np.arange(len(asked))
    shape = (len(columns), 2, 2, len(asked), CELLS)

    def scores(batches: Iterator) -> np.ndarray:
        """Histograms of the scores of all rows and of the loads' own, of the whole model and without each column."""
        out = np.zeros(shape)
        flat_load = np.arange(len(asked)) * CELLS
        for batch in batches:
            own, fold, code = _unpack(batch, len(columns))
            own = place[own]
            w = shared.value
            for a in range(0, len(own), 8192):
                o, f, c = own[a : a + 8192], 1 - fold[a : a + 8192], code[a : a + 8192]
                parts = [w[f, c[:, j]] for j in range(len(columns))]
                z = sum(parts)
                for j, part in enumerate(parts):
                    there = c[:, j] != bins.missing[j]
                    mine = np.flatnonzero(there & (o >= 0))
                    for v, s in enumerate((z, z - part)):
                        cell = np.clip((s + REACH) * (CELLS / 2 / REACH), 0, CELLS - 1).astype(np.int32)
                        out[j, v, 0] += np.bincount((cell[there] + flat_load).ravel(), minlength=len(asked) * CELLS).reshape(len(asked), CELLS)
                        out[j, v, 1] += np.bincount(cell[mine, o[mine]] + flat_load[o[mine]], minlength=len(asked) * CELLS).reshape(len(asked), CELLS)
        return out.ravel()

    seen = _summed(coded.select("_load", "_fold", "_codes"), scores, int(np.prod(shape))).reshape(shape)
    ramp = np.arange(CELLS, dtype=float)
    out = []
    for y, x in enumerate(asked):
        for j, c in enumerate(columns):
            whole, without = (_area(seen[j, v, 1, y], seen[j, v, 0, y] - seen[j, v, 1, y], ramp) for v in (0, 1))
            out.append((loads[x], c, int(counts[x, j]), float(alone[x, j]), whole, without, float(gain[x, j])))
    return out


def distribution_faults(tests: list[tuple]) -> list[tuple]:
    """(load, column) whose values are spread differently: the whole model tells the load apart, the column alone does, and its ablation costs or is made up for by other changed columns."""
    return [(load, c) for load, c, n, alone, whole, without, gain in tests if told_apart(whole, n) and told_apart(alone, n) and (whole - without >= DROP or (gain >= GAIN and told_apart(without, n)))]


def coded_rows(
    df: DataFrame, counts: DataFrame, per_load: list, usual: dict[str, set[str]], compared: list[str], bounds: DataFrame | None, load_col: str, item_col: str, group_col: str | None
) -> tuple[DataFrame, Bins, list]:
    """Each row's load, fold and bins, and whether it is drawn for the fit; the bins; the loads. Copies of an item lie in one fold."""
    loads = sorted(r["_load"] for r in per_load)
    place = {x: i for i, x in enumerate(loads)}
    drawn = {place[r["_load"]]: min(1.0, FIT_ROWS / r["_rows"]) for r in per_load}
    numeric = [c for c in compared if df.schema[c].dataType.typeName() in NUMERIC]
    rows, outside = _bounded(df.where(F.col(f"`{load_col}`").isNotNull()), compared, bounds, group_col)
    item = F.xxhash64(F.col(f"`{item_col}`").cast("string"), F.lit(7))
    values = rows.select(
        F.col(f"`{load_col}`").alias("_load"), item.alias("_hash"),
        *[F.when(~outside[c], F.col(f"`{c}`")).cast("double").alias(c) if c in outside else F.col(f"`{c}`").cast("double" if c in numeric else "string").alias(c) for c in compared],
    )
    bins = _bins(values, counts, numeric, compared, {c: f for c, f in usual.items() if c in compared})
    chance = np.array([drawn[i] for i in range(len(loads))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            d = batch.column(0).dictionary_encode()
            own = np.array([place[x] for x in d.dictionary.to_pylist()], np.int32)[d.indices.to_numpy()]
            hashed = batch.column(1).to_numpy().view(np.uint64)
            fit = (hashed >> np.uint64(33)) / float(1 << 31) < chance[own]
            code = bins.code(batch)
            step = code.shape[1] * 4
            packed = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.arange(0, (len(own) + 1) * step, step, dtype=np.int32)), pa.py_buffer(code.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array((hashed & np.uint64(1)).astype(np.int32)), packed, pa.array(fit)], names=["_load", "_fold", "_codes", "_fit"])

    return values.mapInArrow(run, "_load int, _fold int, _codes binary, _fit boolean"), bins, loads


def _looked_at(df: DataFrame, compared: list[str], *more: list[str]) -> list[str]:
    """The columns whose values are counted one by one."""
    return list(dict.fromkeys([c for c in compared if df.schema[c].dataType.typeName() not in NUMERIC] + [c for x in more for c in x]))


def _usual(usual_forms: DataFrame) -> dict[str, set[str]]:
    out: dict[str, set[str]] = defaultdict(set)
    for r in usual_forms.collect():
        out[r._column].add(r._form)
    return out


def compare_loads(
    df: DataFrame, compared: list[str], pattern_columns: list[str], bounds: DataFrame | None = None, load_col: str = "load_no", item_col: str = "row_no", group_col: str | None = "collection"
) -> list[tuple]:
    """The two-sample test of every load and compared column."""
    counts = value_counts(long_values(df, load_col, _looked_at(df, compared, pattern_columns))).persist()
    try:
        per_load = [r.asDict() for r in load_counts(df, compared, load_col).collect()]
        usual = {c: set() for c in pattern_columns} | _usual(form_counts(counts, pattern_columns)[1])
        coded, bins, loads = coded_rows(df, counts, per_load, usual, compared, bounds, load_col, item_col, group_col)
        coded.persist()
        try:
            return two_sample_test(coded, bins, loads)
        finally:
            coded.unpersist()
    finally:
        counts.unpersist()


def find_faults(
    df: DataFrame, reports: DataFrame | None, columns: list[str], compared: list[str], pattern_columns: list[str], unique_columns: list[str],
    bounds: DataFrame | None = None, load_col: str = "load_no", item_col: str = "row_no", group_col: str | None = "collection", steps: int | None = None,
) -> DataFrame:
    """(load_no, column_name, issue) of every fault."""
    spark, kind = df.sparkSession, df.schema[load_col].dataType.simpleString()
    counts = value_counts(long_values(df, load_col, _looked_at(df, compared, pattern_columns, unique_columns))).persist()
    try:
        per_load = [r.asDict() for r in load_counts(df, columns, load_col, bounds, group_col).collect()]
        of_form, usual_forms = form_counts(counts, pattern_columns)
        usual = {c: set() for c in pattern_columns} | _usual(usual_forms)
        odd = of_form.join(usual_forms, ["_column", "_form"], "left_anti").groupBy("_load", "_column").agg(F.sum("_n").alias("n"))
        unique = counts.where(F.col("_column").isin(*unique_columns) & _present(F.col("_value"))).groupBy("_load", "_column").agg(F.count(F.lit(1)).alias("n"))
        found = base_faults(per_load, columns, *({(r._load, r._column): r.n for r in x.collect()} for x in (odd, unique)))
        coded, bins, loads = coded_rows(df, counts, per_load, usual, compared, bounds, load_col, item_col, group_col)
        coded.persist()
        try:
            found += [(x, c, "distribution") for x, c in distribution_faults(two_sample_test(coded, bins, loads, True, steps))]
        finally:
            coded.unpersist()
    finally:
        counts.unpersist()
    out = spark.createDataFrame(found, f"_load {kind}, _column string, issue string")
    if reports is not None:
        one = spark.createDataFrame([(r["_load"], c, r["_rows"], r[f"p{i}"]) for r in per_load for i, c in enumerate(columns)], f"_load {kind}, _column string, n_rows long, n_present long")
        out = out.unionAll(reported_faults(one, reports, load_col))
    return out.select(F.col("_load").alias(load_col), F.col("_column").alias("column_name"), "issue")
