"""The three report formats, from a gathered report."""

from __future__ import annotations

import json
from decimal import ROUND_HALF_UP, Decimal

from .model import Options, Pattern, Report, Slot

# fixed values of the formats
BANNER = " patternloom: {} lines -> {} patterns ({:.1f}% reduction) "
MAX_TOKEN, HEAD, TAIL = 50, 20, 10
FEW_VALUES = 20
TAGS = {"error": "ERROR", "warn": "WARN"}
COLORS = {"error": "\x1b[1;31m", "warn": "\x1b[1;33m"}


def count_text(n: int) -> str:
    return f"{n / 1e6:.1f}M" if n >= 1_000_000 else f"{n:,}"


def share(part: float, whole: int) -> float:
    return part / whole * 100 if whole else 0.0


def tenth(x: float) -> float:
    """Rounded to one decimal, halves away from zero, as ``x * 10`` comes out in binary."""
    return float(Decimal(x * 10).quantize(Decimal(1), ROUND_HALF_UP)) / 10


def short_token(token: str) -> str:
    """Tokens of more than 50 bytes: the first 20, dots, the last 10, in whole characters."""
    data = token.encode()
    if len(data) <= MAX_TOKEN:
        return token
    return data[:HEAD].decode(errors="ignore") + "..." + data[len(data) - TAIL :].decode(errors="ignore")


def short_line(line: str) -> str:
    return " ".join(map(short_token, line.split()))


def named_template(p: Pattern) -> str:
    labels = iter([s.label for s in p.slots])
    return " ".join(f"{{{label}}}" if w == "<*>" and (label := next(labels, None)) is not None else w for w in p.template.split())


def _clock(report: Report) -> tuple[str, str] | None:
    if report.first_ts is None or report.last_ts is None:
        return None
    return report.first_ts.strftime("%H:%M:%S"), report.last_ts.strftime("%H:%M:%S")


def _human_slot(s: Slot) -> str:
    if s.numeric:
        return "mean={mean:.0f}, p50={p50:.0f}, p99={p99:.0f}, min={min:.0f}, max={max:.0f}".format(**s.numeric)
    if s.top and s.unique <= FEW_VALUES:
        return ", ".join(f"{v} ({pct:.1f}%)" for v, _, pct in s.top[:5])
    return f"{count_text(s.unique)} unique values"


def human(report: Report, o: Options) -> str:
    out = []
    if not o.no_banner:
        saved = (1 - report.pattern_count / report.total_lines) * 100 if report.total_lines else 0.0
        head = BANNER.format(count_text(report.total_lines), report.pattern_count, saved)
        rule = "─" * (len(head) + 2)
        out += [f"┌{rule}┐", f"│{head}│", f"└{rule}┘"]
        if clock := _clock(report):
            out.append("  Time range: {} UTC -> {} UTC".format(*clock))
        out.append("")
    shown = report.by_count
    if report.pattern_count > len(shown):
        pct = share(sum(p.count for p in shown), report.total_lines)
        out += [f"Showing {len(shown)} of {report.pattern_count} patterns ({pct:.1f}% of lines). Use --top {report.pattern_count} to show all.", ""]
    for rank, p in enumerate(shown, 1):
        tag = f"[{TAGS[p.severity]}]" if p.critical else ""
        tag = f"{COLORS[p.severity]}{tag}\x1b[0m" if tag and not o.no_color else tag
        out.append(f"Pattern #{rank}{' ' + tag if tag else ''} ({count_text(p.count)} occurrences, {share(p.count, report.total_lines):.1f}%)")
        out.append(f'  "{p.template}"')
        if p.slots:
            out.append("  Variables:")
            out += [f"    {s.var_type + ':':10}{_human_slot(s)}" for s in p.slots]
        if o.context > 0 and p.examples:
            out.append("  Examples:")
            out += [f"    | {e}" for e in p.examples]
        out.append("")
    return "".join(f"{line}\n" for line in out)


def _llm_slot(s: Slot) -> str:
    if s.numeric:
        return s.label + ": mean={mean:.0f} p50={p50:.0f} p99={p99:.0f} min={min:.0f} max={max:.0f}".format(**s.numeric)
    if s.top and s.unique <= FEW_VALUES:
        return f"{s.label}: " + " ".join(f"{short_token(v)}({pct:.0f}%)" for v, _, pct in s.top[:5])
    return f"{s.label}: {s.unique} unique"


def _llm_pattern(rank: int, p: Pattern, total: int) -> list[str]:
    tag = f"{TAGS[p.severity]}, " if p.critical else ""
    out = [f"{rank}. [{tag}{share(p.count, total):.1f}%, {p.count} lines] {named_template(p)}"]
    if p.slots:
        out.append("   " + " | ".join(map(_llm_slot, p.slots)))
    return out + [f"   e.g. {short_line(e)}" for e in p.examples]


def llm(report: Report, o: Options) -> str:
    clock = _clock(report)
    span = ", time span: {}-{} UTC".format(*clock) if clock else ""
    out = [f"## Log Analysis: {report.total_lines} lines -> {report.pattern_count} patterns{span}", ""]
    if report.critical:
        out.append(f"### Critical Patterns (errors, warnings): {len(report.critical)}")
        for rank, p in enumerate(report.critical, 1):
            out += _llm_pattern(rank, p, report.total_lines)
        if report.high_volume:
            out += ["", f"### High-Volume Patterns (top {len(report.high_volume)} by count):"]
        for rank, p in enumerate(report.high_volume, 1):
            out.append(f'{rank}. [{share(p.count, report.total_lines):.1f}%] "{named_template(p)}"    ({p.count} lines)')
            out += [f"   e.g. {short_line(e)}" for e in p.examples[:1]]
    else:
        shown = report.by_count
        pct = share(sum(p.count for p in shown), report.total_lines)
        more = report.pattern_count - len(shown)
        if more > 0:
            out.append(f"### Patterns (showing {len(shown)} of {report.pattern_count}, {pct:.1f}% of lines; {more} more patterns omitted):")
        else:
            out.append(f"### Patterns ({report.pattern_count}, {pct:.1f}% of lines):")
        for rank, p in enumerate(shown, 1):
            out += _llm_pattern(rank, p, report.total_lines)
    return "".join(f"{line}\n" for line in out)


def document(report: Report, o: Options) -> dict:
    """The JSON report as a dict; what is absent is left out."""
    patterns = []
    for p in report.by_count:
        slots = []
        for k, s in enumerate(p.slots):
            slot = {"slot": k, "type": s.var_type, "label": s.label, "unique_count": s.unique}
            if s.numeric:
                slot["numeric"] = s.numeric | {"mean": tenth(s.numeric["mean"])}
            if s.top and s.unique <= FEW_VALUES:
                slot["top_values"] = [{"value": v, "count": n, "pct": tenth(pct)} for v, n, pct in s.top[:10]]
            slots.append(slot)
        one = {
            "id": p.id, "template": p.template, "count": p.count, "frequency_pct": tenth(share(p.count, report.total_lines)),
            "score": tenth(p.score), "severity": p.severity, "variables": slots,
        }
        patterns.append(one | ({"example_lines": p.examples} if p.examples else {}))
    summary = {"total_lines": report.total_lines, "pattern_count": report.pattern_count, "patterns_shown": len(patterns), "patterns_omitted": report.pattern_count - len(patterns)}
    if report.first_ts is not None and report.last_ts is not None:
        summary["time_range"] = {"start": _rfc3339(report.first_ts), "end": _rfc3339(report.last_ts)}
    return {"version": "0.1.0", "summary": summary, "patterns": patterns}


def _rfc3339(ts) -> str:
    digits = f"{ts.microsecond:06d}"
    fraction = "" if digits == "000000" else "." + (digits[:3] if digits.endswith("000") else digits)
    return ts.strftime("%Y-%m-%dT%H:%M:%S") + fraction + "+00:00"


def json_text(report: Report, o: Options) -> str:
    return json.dumps(document(report, o), ensure_ascii=False, separators=(",", ":"))


FORMATS = {"human": human, "llm": llm, "json": json_text}


def render(report: Report, o: Options) -> str:
    """Unknown formats are rendered as human."""
    return FORMATS.get(o.format, human)(report, o)
