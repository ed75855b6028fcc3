"""SQL twins of the tables in ``order_tables``, as named WITH-clauses."""

from __future__ import annotations

VIEWS = {
    "facts": """
        SELECT l_orderkey AS id,
               round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue,
               CAST(sum(l_quantity) AS INTEGER) AS runtime,
               avg(l_quantity) / 5 AS vote_average,
               count(*) AS vote_count,
               list_sort(list(DISTINCT p_type)) AS genres,
               list_sort(list(DISTINCT p_brand)) AS brands,
               arg_min(p_brand, row(l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity))
                 AS lead_brand
        FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY l_orderkey""",
    "movies": """
        SELECT o_orderkey AS id,
               'Order ' || o_orderkey AS title,
               o_orderpriority || ' for ' || o_custkey AS original_title,
               CAST(o_orderdate AS DATE) AS release_date,
               CAST(year(o_orderdate) AS INTEGER) AS release_year,
               CAST(month(o_orderdate) AS INTEGER) AS release_month,
               o_totalprice AS budget,
               coalesce(revenue, 0.0) AS revenue,
               runtime,
               coalesce(vote_average, 0.0) AS vote_average,
               CAST(coalesce(vote_count, 0) AS BIGINT) AS vote_count,
               o_totalprice / 1000 AS popularity,
               o_orderstatus AS original_language,
               o_orderpriority = '1-URGENT' AS adult,
               coalesce(genres, []) AS genres,
               CASE WHEN lead_brand IS NULL THEN []
                    ELSE list_concat([lead_brand], list_filter(brands, lambda b: b <> lead_brand))
               END AS production_companies
        FROM orders LEFT JOIN facts ON id = o_orderkey""",
    "lead_cast": """
        SELECT l_orderkey AS movie_id,
               arg_min(l_partkey, row(l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity))
                 AS lead_cast_id,
               arg_min(p_name, row(l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity))
                 AS lead_cast_name
        FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY l_orderkey""",
    "directors": """
        SELECT l_orderkey AS movie_id,
               arg_min(l_suppkey, row(l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity))
                 AS director_id,
               arg_min(s_name, row(l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity))
                 AS director_name
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        WHERE l_returnflag = 'R'
        GROUP BY l_orderkey""",
    "gold": """
        SELECT id AS movie_id, title, original_title, release_year, release_month, budget,
               budget / 1000000 AS budget_musd, revenue, revenue / 1000000 AS revenue_musd,
               (revenue - budget) / budget AS roi, runtime, vote_average, vote_count, popularity,
               genres, production_companies,
               production_companies[1] AS lead_production_company,
               director_id, director_name, lead_cast_id, lead_cast_name
        FROM movies
        LEFT JOIN directors ON directors.movie_id = id
        LEFT JOIN lead_cast ON lead_cast.movie_id = id
        WHERE budget >= 10000 AND revenue > 0""",
    "by_genre": """
        SELECT gold.*, unnest(genres) AS genre FROM gold""",
}


def with_gold(body: str, **extra: str) -> str:
    """``body`` with the views above, and any further ones, available to it."""
    clauses = ",\n".join(f"{name} AS ({sql})" for name, sql in {**VIEWS, **extra}.items())
    return f"WITH {clauses}\n{body}"


def with_views(body: str, **extra: str) -> str:
    """``body`` with only the given views."""
    clauses = ",\n".join(f"{name} AS ({sql})" for name, sql in extra.items())
    return f"WITH {clauses}\n{body}"
