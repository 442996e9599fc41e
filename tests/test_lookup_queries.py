"""The registered look-ups on tables of their own against their SQL."""

import pytest

from quarry.plans.verify import TABLES, compare

NAMES = ["quiz_name_by_post", "quiz_name_lookup", "category_choices", "category_choices_no_terms",
         "distinct_categories", "question_types"]


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lookups"))
    rows = {
        "region": ("r_regionkey int, r_name string", [(0, "ASIA"), (1, "EUROPE")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(i, f"N{i}", i % 2) for i in range(9)]),
        "customer": ("c_custkey long", [(i,) for i in range(1, 60)]),
        "supplier": ("s_suppkey long, s_name string", [(i, f"S{i}") for i in range(1, 20)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int",
                 [(i, f"p{i}", f"B{i % 4}", f"T{i % 6}", i % 13) for i in range(1, 80)]),
        "orders": ("o_orderkey long, o_custkey long", [(i, i * 7 % 41) for i in range(50)]),
    }
    for name in TABLES:
        schema, data = rows.get(name, ("id long", [(1,)]))
        spark.createDataFrame(data, schema).coalesce(1).toPandas().to_parquet(f"{root}/{name}.parquet")
    return compare(spark, root, NAMES, verbose=False)


@pytest.mark.parametrize("name", NAMES)
def test_lookup_matches_its_sql(results, name):
    r = results[name]
    assert "error" not in r, r.get("error")
    assert r["spark_rows"] > 0 and r["cols_match"] and r["hash_match"], r
