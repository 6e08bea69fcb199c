"""Text about a base. It tells what is known already, never runs a job and never raises."""

from __future__ import annotations


def _facts(base) -> tuple[object, dict]:
    return getattr(base, "_made", None), getattr(base, "_counts", None) or {}


def _grain(made) -> str:
    return made.time_unit if made.time_unit == made.collapse else f"{made.time_unit}/{made.collapse}"


def short(base) -> str:
    """One line."""
    made, counts = _facts(base)
    if made is None:
        return "CustomerBase(not initialised)"
    size = f"{counts['with_events']:,} customers, " if counts else ""
    return f"CustomerBase({size}[{_grain(made)}] to {made.observation_end.date()})"


def long(base) -> str:
    """Each choice and what it leads to, which models fit, and notes on thin data."""
    made, counts = _facts(base)
    if made is None:
        return "CustomerBase(not initialised)"
    lines = ["CustomerBase"]
    if counts:
        lines.append(f"  size      {counts['with_events']:,} customers, {counts['repeat_buyers']:,} repeat buyers")
    lines.append(f"  observed  to {made.observation_end.date()}")
    lines.append(f"  time      reported in {made.time_unit!r}, events kept at {made.collapse!r}")
    if made.has_monetary:
        lines.append(f"  refunds   on_negative={made.on_negative!r}")
    else:
        lines.append("  amounts   amount_col=None: no spend")
    repeat = counts.get("repeat_buyers")
    fits = ["BGNBD", "MBGNBD", "CohortSurvival"]
    refused = []
    if made.has_monetary and repeat != 0:
        fits += ["GammaGamma", "CLV"]
    else:
        refused = ["GammaGamma", "CLV"]
    lines.append(f"  fits      {', '.join(fits)}")
    if refused:
        lines.append(f"  refused   {', '.join(refused)} ({'no repeat buyers' if made.has_monetary else 'amount_col=None'})")
    n = counts.get("with_events", 0)
    if n and repeat is not None:
        once = (n - repeat) / n
        if once > 0.5:
            lines.append(f"  note      {once:.0%} bought once")
        if repeat < 100:
            lines.append(f"  note      {repeat} repeat buyers carry the likelihood; see .parameter_uncertainty()")
    return "\n".join(lines)
