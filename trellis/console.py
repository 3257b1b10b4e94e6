"""A console over one engine: queries, explain, profile, source, dump, timeout, help.

    Console(Engine(graph)).loop()          # reads standard input
    Console(Engine(graph)).execute(line)   # the text that a line gives
"""

from __future__ import annotations

import sys

from .engine import Engine
from .errors import QueryError
from .sources import delimited

HELP = """query;            run it and show its rows
explain query     its clauses and Spark's plan
profile query     run it and show rows and time of each step
source FILE       run the statements of a file
dump FILE query   write its rows as delimited text
config KEY VALUE  rows (shown at most) or timeout (seconds, 0 for none)
help, quit"""


class Console:
    def __init__(self, engine: Engine, rows: int = 20, timeout: float = 0.0):
        self.engine, self.config = engine, {"rows": rows, "timeout": timeout}

    def execute(self, line: str) -> str:
        word, _, rest = line.strip().partition(" ")
        try:
            match word.lower():
                case "":
                    return ""
                case "help":
                    return HELP
                case "explain":
                    return self.engine.explain(rest)
                case "profile":
                    return "\n".join(f"{name}: {', '.join(f'{k} {v}' for k, v in what.items())}" for name, what in self.engine.profile(rest))
                case "source":
                    with open(rest.strip()) as f:
                        return "\n".join(self.execute(x) for x in split(f.read()))
                case "dump":
                    at, _, text = rest.strip().partition(" ")
                    delimited.dump(self.engine.run(text), at)
                    return f"written to {at}"
                case "config":
                    key, _, value = rest.strip().partition(" ")
                    if key not in self.config:
                        return f"no setting {key}; there are {', '.join(self.config)}"
                    self.config[key] = type(self.config[key])(value)
                    return f"{key} = {self.config[key]}"
            df = self.engine.run(line)
            got = self.engine.collect(line, timeout=self.config["timeout"] or None)
            shown = ["|".join("" if x is None else str(x) for x in r) for r in got[: self.config["rows"]]]
            return "\n".join(["|".join(df.columns), *shown, f"[{len(got)} rows]"])
        except (QueryError, OSError, ValueError) as e:
            return f"error: {e}"

    def loop(self, lines=sys.stdin, out=sys.stdout) -> None:
        for line in lines:
            if line.strip().lower().rstrip(";") in ("quit", "exit"):
                break
            print(self.execute(line), file=out)


def split(text: str) -> list[str]:
    """Statements of a text: they end in a semicolon that is in no quotes and no comment line."""
    out, now, quote = [], "", ""
    for line in text.splitlines(keepends=True):
        if not quote and line.lstrip().startswith("//"):
            continue
        for c in line:
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"`":
                quote = c
            elif c == ";":
                out, now = [*out, now.strip()], ""
                continue
            now += c
    return [s for s in [*out, now.strip()] if s]
