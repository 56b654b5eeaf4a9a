"""Exact quantiles (linear interpolation) without holding a whole column in
one task.

Spark's ``percentile`` aggregate keeps a value->count map of the whole column
in the final aggregation task, which does not survive 100 TB of distinct
doubles. Here every quantile becomes two order statistics (k-th smallest
values) found by histogram refinement:

1. one aggregate gives count/min/max per column and, from
   ``percentile_approx``, a bracket [v(p - 2/accuracy), v(p + 2/accuracy)]
   around every wanted rank; a second aggregate counts the rows below and
   inside each bracket (a bracket that misses its rank is replaced by the
   full range, so the result stays exact);
2. each pass bins the rows still inside the current interval into ``bins``
   bins, equal in width, or in magnitude while the interval spans many powers
   of two or crosses zero, so a handful of passes exhausts the double's bits (one ``groupBy(target, bin)`` with map-side partial
   aggregation, output bounded by targets x bins), and narrows every target to
   the bin that holds its rank, tightened to the bin's actual min/max;
3. once an interval holds at most ``collect_limit`` rows (or one value), its
   value counts are fetched and the rank is read off.

All results reaching the driver are bounded by ``targets x bins`` or
``targets x collect_limit`` rows, independent of the table size. A hot value
(a third of all rows) ends in a single-valued bin and resolves at once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsengine.functions.exprs import col


def _interp(lo_v, hi_v, frac):
    if lo_v is None or hi_v is None:
        return None
    if frac == 0.0:
        return float(lo_v)
    return float(lo_v) + (float(hi_v) - float(lo_v)) * frac


def _wide(lo: float, hi: float) -> bool:
    return not math.isfinite(hi - lo) or (lo < 0 < hi) or lo == 0 or hi == 0 or abs(_magnitude(hi) - _magnitude(lo)) > 12


def _magnitude(v: float) -> float:
    """Monotone in v: the sign times the binary order, from 1 for the least
    positive double up to 2101 for infinity."""
    if v == 0:
        return 0.0
    return math.copysign(min(1025.0, math.log2(abs(v)) if math.isfinite(v) else 1025.0) + 1076, v)


def _magnitude_expr(v):
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.least(F.log2(F.abs(v)), F.lit(1025.0)) + 1076))


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    exact: bool = True, bins: int = 4096,
                    collect_limit: int = 20000,
                    bracket: bool = True, accuracy: int = 10000) -> dict:
    """Return {(column, p): value} with pandas/DuckDB linear interpolation.

    Missing values (null, NaN) are ignored. ``exact=False`` uses
    ``percentile_approx`` in one pass instead.
    """
    cols = list(dict.fromkeys(cols))
    out: dict = {}
    if not cols or not probs:
        return out
    vals = {c: F.when(~F.isnan(col(c).cast("double")), col(c).cast("double"))
            for c in cols}
    if not exact:
        row = df.agg(*[F.percentile_approx(vals[c], list(probs), 100000).alias(f"q{i}")
                       for i, c in enumerate(cols)]).first()
        for i, c in enumerate(cols):
            arr = row[f"q{i}"]
            for j, p in enumerate(probs):
                out[(c, p)] = None if arr is None else float(arr[j])
        return out

    delta = 2.0 / accuracy
    bracket_p = sorted({min(1.0, max(0.0, p + sgn * delta)) for p in probs for sgn in (-1, 1)})
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(vals[c]).alias(f"n{i}"), F.min(vals[c]).alias(f"lo{i}"),
                 F.max(vals[c]).alias(f"hi{i}")]
        if bracket:
            aggs.append(F.percentile_approx(vals[c], bracket_p, accuracy).alias(f"b{i}"))
    row = df.agg(*aggs).first()

    # target key: (column index, k) -> state
    state: dict[tuple[int, int], dict] = {}
    plan: dict[tuple[str, float], tuple] = {}
    for i, c in enumerate(cols):
        n = row[f"n{i}"]
        for p in probs:
            if not n:
                out[(c, p)] = None
                continue
            r = p * (n - 1)
            k0, k1 = int(math.floor(r)), int(math.ceil(r))
            plan[(c, p)] = (i, k0, k1, r - k0)
            if bracket and row[f"b{i}"] is not None:
                b = dict(zip(bracket_p, row[f"b{i}"]))
                lo = b[min(1.0, max(0.0, p - delta))]
                hi = b[min(1.0, max(0.0, p + delta))]
                st = {"lo": lo, "hi": hi, "below": None, "n": None}
            else:
                st = {"lo": row[f"lo{i}"], "hi": row[f"hi{i}"], "below": 0, "n": n}
            for k in (k0, k1):
                state.setdefault((i, k), dict(st))
    # locate each bracket: rows below it and inside it (one aggregate); a
    # bracket that misses its rank falls back to the full [min, max] range
    pending = sorted({(k[0], st["lo"], st["hi"]) for k, st in state.items() if st["below"] is None})
    if pending:
        cnt = []
        for j, (ci, lo, hi) in enumerate(pending):
            v = vals[cols[ci]]
            cnt += [F.count_if(v < F.lit(lo)).alias(f"below{j}"),
                    F.count_if((v >= F.lit(lo)) & (v <= F.lit(hi))).alias(f"inside{j}")]
        crow = df.agg(*cnt).first()
        pos = {iv: j for j, iv in enumerate(pending)}
        for key, st in state.items():
            if st["below"] is not None:
                continue
            j = pos[(key[0], st["lo"], st["hi"])]
            below, inside = crow[f"below{j}"], crow[f"inside{j}"]
            if below <= key[1] < below + inside:
                st.update(below=below, n=inside)
            else:
                st.update(lo=row[f"lo{key[0]}"], hi=row[f"hi{key[0]}"], below=0,
                          n=row[f"n{key[0]}"])
    resolved: dict[tuple[int, int], float] = {}

    def _settle():
        for key, st in state.items():
            if key not in resolved and st["lo"] == st["hi"]:
                resolved[key] = st["lo"]

    _settle()
    while True:
        active = [k for k, st in state.items()
                  if k not in resolved and st["n"] > collect_limit]
        if not active:
            break
        intervals = sorted({(k[0], state[k]["lo"], state[k]["hi"]) for k in active})
        ids = {iv: j for j, iv in enumerate(intervals)}
        entries = []
        for (ci, lo, hi), j in ids.items():
            v = vals[cols[ci]]
            if _wide(float(lo), float(hi)):
                # cut by magnitude first: a bin then spans a factor of two or so
                first, last = _magnitude(float(lo)), _magnitude(float(hi))
                at = (_magnitude_expr(v) - F.lit(first)) / F.lit(last - first)
            else:
                at = (v - F.lit(lo)) / F.lit(float(hi) - float(lo))
            b = F.greatest(F.lit(0), F.least(F.floor(at * F.lit(bins)).cast("int"), F.lit(bins - 1)))
            inside = v.isNotNull() & (v >= F.lit(lo)) & (v <= F.lit(hi))
            entries.append(F.when(inside, F.struct(F.lit(j).alias("t"), b.alias("b"),
                                                   v.alias("v"))))
        hist = (df.select(F.explode(F.array(*entries)).alias("e")).where("e is not null")
                .select("e.t", "e.b", "e.v")
                .groupBy("t", "b")
                .agg(F.count(F.lit(1)).alias("cnt"), F.min("v").alias("mn"),
                     F.max("v").alias("mx"))
                .collect())
        per_t: dict[int, list] = {}
        for h in hist:
            per_t.setdefault(h["t"], []).append((h["b"], h["cnt"], h["mn"], h["mx"]))
        for key in active:
            st = state[key]
            j = ids[(key[0], st["lo"], st["hi"])]
            rank = key[1] - st["below"]
            acc = 0
            for b, cnt, mn, mx in sorted(per_t.get(j, [])):
                if acc + cnt > rank:
                    st.update(lo=mn, hi=mx, below=st["below"] + acc, n=cnt)
                    break
                acc += cnt
        _settle()

    left = [k for k in state if k not in resolved]
    if left:
        intervals = sorted({(k[0], state[k]["lo"], state[k]["hi"]) for k in left})
        ids = {iv: j for j, iv in enumerate(intervals)}
        entries = []
        for (ci, lo, hi), j in ids.items():
            v = vals[cols[ci]]
            inside = v.isNotNull() & (v >= F.lit(lo)) & (v <= F.lit(hi))
            entries.append(F.when(inside, F.struct(F.lit(j).alias("t"), v.alias("v"))))
        rows = (df.select(F.explode(F.array(*entries)).alias("e")).where("e is not null")
                .select("e.t", "e.v").groupBy("t", "v").count().collect())
        per_t: dict[int, list] = {}
        for r_ in rows:
            per_t.setdefault(r_["t"], []).append((r_["v"], r_["count"]))
        for key in left:
            st = state[key]
            j = ids[(key[0], st["lo"], st["hi"])]
            rank = key[1] - st["below"]
            acc = 0
            for v, cnt in sorted(per_t.get(j, [])):
                if acc + cnt > rank:
                    resolved[key] = v
                    break
                acc += cnt

    for (c, p), (i, k0, k1, frac) in plan.items():
        out[(c, p)] = _interp(resolved.get((i, k0)), resolved.get((i, k1)), frac)
    return out
