"""A throughput test: weighted query templates in an open loop, with latency percentiles for each.

Queries start at a fixed rate whether or not earlier ones have ended, up to `workers` at once; a latency is counted from
the time at which the query was due. $RAND in a template stands for the id of a vertex whose degree lies between two
percentiles, so that runs are alike.
"""

from __future__ import annotations

import random
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from .engine import Engine

PERCENTILES = (50, 90, 95, 99)


@dataclass(frozen=True)
class Template:
    name: str
    text: str
    label: str | None = None  # of the vertices that $RAND stands for
    weight: float = 1.0
    timeout: float | None = None
    edge: str | None = None  # type whose degree counts
    low: int = 40
    high: int = 60


def read(path: str) -> tuple[dict[str, str], list[Template]]:
    """Settings (key = value) and templates: text|label|property|weight|timeout in ms[|direction|edge type]. A comment line
    before a template is its name."""
    settings, templates, name = {}, [], ""
    with open(path) as f:
        for line in map(str.strip, f):
            if line.startswith("#"):
                name = line[1:].strip()
            elif line.count("|") >= 4:
                text, label, _, weight, timeout, *rest = line.split("|")
                templates.append(Template(name or f"q{len(templates)}", text, label or None, float(weight), float(timeout) / 1000, rest[1] if len(rest) > 1 else None))
                name = ""
            elif "=" in line:
                k, _, v = line.partition("=")
                settings[k.strip()] = v.strip()
    return settings, templates


def percentile(values: list[float], p: float) -> float:
    """By nearest rank; 0 without values."""
    v = sorted(values)
    return v[min(len(v) - 1, max(0, -(-len(v) * p // 100) - 1).__int__())] if v else 0.0


def run(engine: Engine, templates: list[Template], rate: float, seconds: float, workers: int = 8, seed: int = 7) -> dict:
    """Queries a second, and by template: runs, errors (timeouts are errors), and latencies in ms at PERCENTILES."""
    pick = random.Random(seed)
    ids = {t: engine.graph.sample_ids(t.label, t.edge, t.low, t.high, 100, seed) if t.label else [] for t in templates}
    order = pick.choices(templates, [t.weight for t in templates], k=max(1, int(rate * seconds)))
    jobs = [(k / rate, t, pick.choice(ids[t]) if ids[t] else None) for k, t in enumerate(order)]
    took: dict[str, list[float]] = {t.name: [] for t in templates}
    failed = dict.fromkeys(took, 0)
    began = time.monotonic()

    def one(due: float, t: Template, who) -> None:
        try:
            engine.collect(t.text.replace("$RAND", str(who)), timeout=t.timeout)
            took[t.name].append((time.monotonic() - began - due) * 1000)
        except Exception:  # noqa: BLE001  a failed query is counted, the test goes on
            failed[t.name] += 1

    with ThreadPoolExecutor(workers) as pool:
        for due, t, who in jobs:
            time.sleep(max(0.0, began + due - time.monotonic()))
            pool.submit(one, due, t, who)
    spent = time.monotonic() - began
    ms = lambda v: {f"p{p}": round(percentile(v, p), 1) for p in PERCENTILES}
    every = [x for v in took.values() for x in v]
    return {"per_second": round(len(every) / spent, 2), "seconds": round(spent, 2), **ms(every), "templates": {n: {"runs": len(v), "errors": failed[n], **ms(v)} for n, v in took.items()}}
