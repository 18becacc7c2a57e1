"""DuckDB SQL twins of the fixture views (FIXTURES.md), used as CTEs by the oracle queries."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    VIEWS[name] = (deps, sql)


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies first)."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"


view(
    "survey",
    """
SELECT o.o_orderkey AS respondent_id,
       CAST(year(o.o_orderdate) AS INT) AS wave,
       CASE WHEN o.o_orderkey % 3 = 0 THEN '0810' ELSE '0012' END AS form,
       CAST(CASE WHEN o.o_orderkey % 29 = 0 THEN -9 WHEN o.o_orderkey % 31 = 0 THEN -8
            ELSE CAST(substr(o.o_orderpriority, 1, 1) AS INT) END AS INT) AS nicotine12,
       CAST(CASE WHEN o.o_orderkey % 37 = 0 THEN -9 ELSE 1 + (o.o_custkey % 2) END AS INT) AS sex_raw,
       c.c_mktsegment AS race,
       CAST(n.n_regionkey + 1 AS INT) AS region,
       CAST(CASE WHEN o.o_orderkey % 41 = 0 THEN -9 ELSE least(coalesce(l.n_lines, 0), 6) + 1 END AS INT) AS marijuana12,
       CAST(CASE WHEN o.o_orderkey % 43 = 0 THEN -8 ELSE coalesce(l.n_ret, 0) % 7 + 1 END AS INT) AS alcohol12,
       CAST(CASE WHEN o.o_orderkey % 47 = 0 THEN -9 ELSE coalesce(l.max_line, 0) + 1 END AS INT) AS cigarette12,
       CASE WHEN o.o_orderkey % 53 = 0 THEN NULL ELSE o.o_totalprice / 1000.0 END AS survey_weight
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, max(l_linenumber) AS max_line,
                  sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret
           FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
""",
)

view(
    "survey_nonull",
    """
SELECT respondent_id,
       CASE WHEN wave IN (-9, -8) THEN NULL ELSE wave END AS wave,
       form,
       CASE WHEN nicotine12 IN (-9, -8) THEN NULL ELSE nicotine12 END AS nicotine12,
       CASE WHEN sex_raw IN (-9, -8) THEN NULL ELSE sex_raw END AS sex_raw,
       race,
       CASE WHEN region IN (-9, -8) THEN NULL ELSE region END AS region,
       CASE WHEN marijuana12 IN (-9, -8) THEN NULL ELSE marijuana12 END AS marijuana12,
       CASE WHEN alcohol12 IN (-9, -8) THEN NULL ELSE alcohol12 END AS alcohol12,
       CASE WHEN cigarette12 IN (-9, -8) THEN NULL ELSE cigarette12 END AS cigarette12,
       CASE WHEN survey_weight IN (-9, -8) THEN NULL ELSE survey_weight END AS survey_weight
FROM survey
""",
    ("survey",),
)

view(
    "survey_clean",
    """
SELECT respondent_id, wave,
       CAST(CASE sex_raw WHEN 1 THEN 0 WHEN 2 THEN 1 END AS INT) AS sex,
       race, region, marijuana12, alcohol12, cigarette12, survey_weight,
       CASE WHEN nicotine12 = 1 THEN CAST(0 AS DOUBLE) WHEN nicotine12 >= 2 THEN CAST(1 AS DOUBLE) END AS y
FROM survey_nonull
WHERE (nicotine12 = 1 OR nicotine12 >= 2) AND sex_raw IN (1, 2) AND race IS NOT NULL
""",
    ("survey_nonull",),
)

view(
    "importances",
    """
SELECT 'm' || CAST(l.l_linenumber AS VARCHAR) AS model, p.p_brand AS feature,
       p.p_brand || ':' || p.p_type AS slot, sum(l.l_extendedprice) AS importance
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY l.l_linenumber, p.p_brand, p.p_type
""",
)

view(
    "feature_importances",
    "SELECT model, feature, sum(importance) AS importance FROM importances GROUP BY model, feature",
    ("importances",),
)

view(
    "scored",
    """
SELECT o_orderkey AS row_id,
       CAST(o_orderstatus = 'F' AS INT) AS label,
       CAST(least(greatest(o_totalprice / 500000.0, 0.001), 0.999) AS DOUBLE) AS prob,
       CAST(least(greatest(o_totalprice / 500000.0, 0.001), 0.999) >= 0.5 AS INT) AS pred,
       round(CAST(least(greatest(o_totalprice / 500000.0, 0.001), 0.999) AS DOUBLE), 2) AS prob2,
       o_orderstatus AS label3,
       CAST(year(o_orderdate) AS INT) AS year
FROM orders
""",
)
