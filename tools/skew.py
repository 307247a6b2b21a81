"""Write a copy of a data folder in which one key of every table holds a third of all rows.

usage: python tools/skew.py SOURCE_DIR TARGET_DIR
"""

from __future__ import annotations

import sys

import duckdb

HOT = {
    "lineitem": "CASE WHEN hash(l_orderkey, l_partkey, l_suppkey, l_extendedprice) % 3 = 0 THEN 1 ELSE l_orderkey END AS l_orderkey",
    "orders": "CASE WHEN hash(o_orderkey) % 3 = 0 THEN 1 ELSE o_custkey END AS o_custkey",
    "events": "CASE WHEN hash(event_id) % 3 = 0 THEN 1 ELSE user_id END AS user_id",
    "customer": "CASE WHEN hash(c_custkey) % 3 = 0 THEN 3 ELSE c_nationkey END AS c_nationkey",
    "supplier": "CASE WHEN hash(s_suppkey) % 3 = 0 THEN 3 ELSE s_nationkey END AS s_nationkey",
    "part": "CASE WHEN hash(p_partkey) % 3 = 0 THEN 'Brand#2' ELSE p_brand END AS p_brand",
    "documents": "CASE WHEN hash(doc_id) % 3 = 0 THEN (SELECT text FROM src WHERE doc_id = 5) ELSE text END AS text",
    "pages": "CASE WHEN hash(page_id) % 3 = 0 THEN (SELECT html FROM src WHERE page_id = 5) ELSE html END AS html",
}
PLAIN = ["region", "nation", "embeddings", "benchmark", "labels"]


def main(source: str, target: str) -> None:
    con = duckdb.connect()
    for name, expr in HOT.items():
        con.execute(f"CREATE OR REPLACE VIEW src AS SELECT * FROM '{source}/{name}.parquet'")
        con.execute(f"COPY (SELECT * REPLACE ({expr}) FROM src) TO '{target}/{name}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE OR REPLACE VIEW src AS SELECT * FROM '{source}/conversations.parquet'")
    hot = "CASE WHEN hash(conv_id, turn) % 3 = 0 THEN 0 ELSE conv_id END"
    con.execute(
        f"COPY (SELECT c AS conv_id, row_number() OVER (PARTITION BY c ORDER BY o, turn) - 1 AS turn, role, text FROM "
        f"(SELECT *, {hot} AS c, conv_id AS o FROM src)) TO '{target}/conversations.parquet' (FORMAT parquet)"
    )
    for name in PLAIN:
        con.execute(f"COPY (SELECT * FROM '{source}/{name}.parquet') TO '{target}/{name}.parquet' (FORMAT parquet)")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2])
