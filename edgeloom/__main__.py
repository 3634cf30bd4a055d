"""python -m edgeloom --edges FILE --bootstrap FILE --chunk-length N --num-parallel-graphs N [--max-num-edges N|inf] [--dataset all|ydc|gfc] [--out FOLDER] [--work-dir FOLDER]"""

from __future__ import annotations

import argparse

from edgeloom.config import DATASETS, Config
from edgeloom.plans import report
from edgeloom.sources.edges import read_bootstrap, read_edges


def limit(text: str) -> int | None:
    return None if text.lower() == "inf" else int(text)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="edgeloom", description="Clusters and scores graphs whose typed edges arrive as a stream.")
    p.add_argument("--edges", required=True, help="tab-separated edges in order of arrival")
    p.add_argument("--bootstrap", required=True, help="bootstrap clusters and thresholds")
    p.add_argument("--chunk-length", type=int, required=True)
    p.add_argument("--num-parallel-graphs", type=int, required=True)
    p.add_argument("--max-num-edges", type=limit, default=None, help="edges that are live at a time; inf or 0: all")
    p.add_argument("--dataset", choices=sorted(DATASETS), default="all")
    p.add_argument("--out", help="folder for Parquet tables")
    p.add_argument("--work-dir", help="folder for tables between stages, shared by all machines (spark.checkpoint.dir)")
    a = p.parse_args(argv)
    config = Config(chunk_length=a.chunk_length, parallel_graphs=a.num_parallel_graphs, max_edges=a.max_num_edges, dataset=a.dataset)
    spark = report.session(work_dir=a.work_dir)
    members, thresholds, global_threshold = read_bootstrap(spark, a.bootstrap)
    result = report.run(read_edges(spark, a.edges), members, thresholds, global_threshold, config)
    for line in report.lines(result):
        print(line)
    if a.out:
        report.write(result, a.out)


if __name__ == "__main__":
    main()
