"""Write BENCH_NOTES.md from two ``bench.py --all`` JSON lines (sf0.01 and
sf0.1): seconds per query and the growth factor for 10x rows.

usage: python tools/bench_notes.py small.json large.json > BENCH_NOTES.md
"""

import json
import sys


def main():
    small = json.loads(open(sys.argv[1]).read().strip().splitlines()[-1])
    large = json.loads(open(sys.argv[2]).read().strip().splitlines()[-1])
    print("# Measured query times\n")
    print(f"`bench.py --all` on local[{large.get('cpus')}] (one JVM). Seconds per query, each fully executed "
          "(noop sink), after one warm-up scan. Growth = time at sf0.1 / time at sf0.01 (10x rows); "
          "values near 1 mean fixed per-query overhead (planning, job scheduling, small files) dominates.\n")
    print(f"Totals: sf{small['sf']} {small['value']:.1f} s, sf{large['sf']} {large['value']:.1f} s.\n")
    print("| query | sf0.01 s | sf0.1 s | growth |")
    print("|---|---:|---:|---:|")
    for name, t in sorted(large["queries"].items(), key=lambda kv: -kv[1]):
        s = small["queries"].get(name)
        g = f"{t / s:.1f}" if s else "-"
        print(f"| {name} | {s if s is not None else '-'} | {t} | {g} |")


if __name__ == "__main__":
    main()
