"""Aggregates over a group's rows in time order.

Each is window columns over the rows (so rows stay distributed and nothing is
collected) and a plain aggregate of them, which combines before its shuffle.
A builder takes the argument texts and gives `Ordered`: stages of window columns,
each stage above the one before it, and the aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from .times import us


@dataclass
class Ordered:
    order: str
    stages: list[dict[str, str]]
    result: str


# In the texts, {over} stands for OVER (PARTITION BY the group ORDER BY the order),
# {upto} for the same with the frame of all rows so far, {all} for the whole group,
# and {k} for a number that keeps names apart.


def twap(price: str, ts: str) -> Ordered:
    held = f"{us(f'lead({ts}) {{over}}')} - {us(ts)}"
    w = "_w{k}"
    return Ordered(
        ts,
        [{w: f"CAST({held} AS DOUBLE)"}],
        f"CASE WHEN sum(CASE WHEN ({price}) IS NOT NULL THEN {w} END) > 0 THEN sum(({price}) * {w}) / sum(CASE WHEN ({price}) IS NOT NULL THEN {w} END) ELSE avg({price}) END",
    )


def updownticks(time: str, tie: str, price: str, size: str) -> Ordered:
    p, q = f"({price})", "_p{k}"
    up, down, same = f"{p} > {q}", f"{p} < {q}", f"{p} = {q}"
    counts = ", ".join(f"CAST(count_if({c}) AS DOUBLE)" for c in (up, down, same))
    sizes = ", ".join(f"CAST(coalesce(sum(CASE WHEN {c} THEN {size} END), 0) AS DOUBLE)" for c in (up, down, same))
    return Ordered(f"{time}, {tie}", [{q: f"lag({p}) {{over}}"}], f"array({counts}, {sizes})")


def run_structure(time: str, tie: str, side: str, price: str) -> Ordered:
    buy = f"(({side}) = 'buy')"
    first = {
        "_b{k}": buy,
        "_s{k}": f"lag({buy}) {{over}}",
        "_n{k}": f"lead({buy}) {{over}}",
        "_q{k}": f"lag({price}) {{over}}",
        "_r{k}": "row_number() {over}",
    }
    second = {"_l{k}": "_r{k} - max(CASE WHEN NOT (_s{k} <=> _b{k}) THEN _r{k} END) {upto} + 1"}
    ends = "NOT (_n{k} <=> _b{k})"
    flip = "_s{k} IS NOT NULL AND _s{k} <> _b{k}"
    parts = [f"coalesce(max(CASE WHEN {ends} AND {c} THEN _l{{k}} END), 0)" for c in ("_b{k}", "NOT _b{k}")]
    parts += [f"coalesce(avg(CASE WHEN {ends} AND {c} THEN _l{{k}} END), 0)" for c in ("_b{k}", "NOT _b{k}")]
    parts += [f"count_if({flip})", "count(*)"]
    parts = [f"CAST({p} AS DOUBLE)" for p in parts]
    parts.append(f"avg(CASE WHEN {flip} AND _q{{k}} <> 0 THEN abs(({price}) / _q{{k}} - 1) END)")
    return Ordered(f"{time}, CAST({tie} AS BIGINT)", [first, second], f"array({', '.join(parts)})")


def trade_returns(time: str, t1: str, t2: str, price: str, side: str, size: str) -> Ordered:
    buy = f"(({side}) = 'buy')"
    signed = f"CASE WHEN {buy} THEN ({size}) ELSE -({size}) END"
    r = "_r{k}"
    first = {"_q{k}": f"lag({price}) {{over}}", "_i{k}": "row_number() {over}"}
    second = {r: f"CASE WHEN _q{{k}} <> 0 THEN ({price}) / _q{{k}} - 1 END"}
    parts = [
        f"sqrt(coalesce(sum({r} * {r}), 0D))",
        f"covar_samp({r}, {signed})",
        f"var_samp({signed})",
        f"avg(CASE WHEN {buy} THEN {r} END)",
        f"avg(CASE WHEN NOT {buy} THEN -{r} END)",
        f"min_by({price}, _i{{k}})",
        f"max_by({price}, _i{{k}})",
    ]
    return Ordered(f"{time}, {t1}, {t2}", [first, second], f"array({', '.join(f'CAST({p} AS DOUBLE)' for p in parts)})")


def trade_reversal(ahead: str, level: str, time: str, t1: str, t2: str, price: str, side: str, size: str) -> Ordered:
    notional = f"abs(({size}) * ({price}))"
    first = {"_a{k}": f"lead({price}, {ahead}) {{over}}", "_p{k}": f"percentile({notional}, {level}) {{all}}"}
    return Ordered(f"{time}, {t1}, {t2}", [first], f"avg(CASE WHEN {notional} >= _p{{k}} AND ({price}) <> 0 AND _a{{k}} IS NOT NULL THEN _a{{k}} / ({price}) - 1 END)")


def distinct_stats(time: str, tie: str, x: str) -> Ordered:
    new = f"(({x}) IS NOT NULL AND NOT (({x}) <=> _q{{k}}))"
    value, change = f"CASE WHEN {new} THEN ({x}) END", f"CASE WHEN {new} AND _q{{k}} <> 0 THEN (({x}) - _q{{k}}) / _q{{k}} END"
    return Ordered(f"{time}, {tie}", [{"_q{k}": f"lag({x}) {{over}}"}], f"array(avg({value}), stddev_samp({value}), stddev_samp({change}))")


#: Builder, number of parameters before the arguments, and whether the arguments are one tuple.
ORDERED = {
    "twap": (twap, 0, False),
    "updownticks": (updownticks, 0, True),
    "run_structure": (run_structure, 0, True),
    "trade_returns": (trade_returns, 0, True),
    "trade_reversal": (trade_reversal, 2, True),
    "distinct_stats": (distinct_stats, 0, True),
}
