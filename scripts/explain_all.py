"""Write PLANS.md: the physical plan tree of every analysis.

Usage: python scripts/explain_all.py [sf_dir]   (default /root/testdata/sf0.1)
Only the operator tree of `explain("formatted")` is kept, plus the scan lines
(ReadSchema / PushedFilters), so the shape of each plan can be reviewed at a
glance: where it shuffles, what is broadcast, what reaches the scan.
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pingscape.plans import catalog  # noqa: E402
from pingscape.session import local_session  # noqa: E402


def tree_and_scans(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    lines = buf.getvalue().splitlines()
    out, in_tree = [], True
    for line in lines:
        if in_tree:
            if line.startswith("== Physical Plan") or not line.strip():
                if out and not line.strip():
                    in_tree = False
                continue
            out.append(line)
        elif line.startswith(("PushedFilters", "ReadSchema")):
            out.append("    " + line)
    return "\n".join(out)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    parts = [
        "# Physical plans",
        "",
        f"Generated by `scripts/explain_all.py` at `{os.path.basename(sf_dir)}` (AQE plans before execution;",
        "`BroadcastExchange` sides passed the size check in `operators/cells.py`).",
        "",
    ]
    for name, q in catalog.QUERIES.items():
        parts += [f"## {name}", "", "```", tree_and_scans(q(spark, sf_dir)), "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(parts))
    spark.stop()


if __name__ == "__main__":
    main()
