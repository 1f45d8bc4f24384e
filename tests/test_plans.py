"""Physical plans: what must and must not be in them."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tablescope.operators import categorical as C, hypothesis as T, logs as G, numeric as U, overview as O, query as Q, relations as L, timeseries as M
from tablescope.plans import frequency
from tablescope.plans.moments import moments
from tablescope.registry import all_entries
from tablescope.registry.frames import calls


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def lines(df, word):
    return [x for x in plan(df).splitlines() if word in x]


# operators without any SQL of their own to run: their plans must not pair rows
@pytest.mark.parametrize("name", [
    "rolling_mean_30d", "rolling_mean_by_key", "gap_list", "value_shares", "frequency_encode", "target_encode", "kruskal_wallis", "spearman_matrix",
    "corr_matrix", "group_describe", "context_pack", "log_running_totals", "dedup_files", "describe_all", "quality_issues", "cardinality_class"])
def test_no_cross_join(spark, name):
    text = plan(all_entries()[name][0](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(read):
    text = plan(Q.lookup_value(read("orders"), "o_orderkey", 5).select("o_orderkey", "o_totalprice"))
    assert "EqualTo(o_orderkey,5)" in text
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>", text)
    text = plan(moments(read("lineitem"), ["l_tax"]))
    assert "ReadSchema: struct<l_tax:double>" in text


def test_moments_are_one_scan_and_one_shuffle(read):
    df = moments(read("lineitem"))
    assert len(lines(df, "FileScan")) == 1
    assert len(lines(df, "Exchange hashpartitioning")) == 1


def test_top_values_are_limited_before_the_shuffle(read):
    text = plan(C.value_counts(read("part")))
    assert "WindowGroupLimit" in text and "Partial" in text[text.index("WindowGroupLimit"):]


def test_sorted_heads_do_not_sort_everything(read):
    assert "TakeOrderedAndProject" in plan(Q.top_k(read("orders"), "o_totalprice", 5, ["o_orderkey"]))
    assert "TakeOrderedAndProject" in plan(Q.sample_rows(read("orders"), ["o_orderkey"], 5))


def test_ranks_are_moved_as_often_for_any_number_of_columns(read):
    numbers = ["l_quantity", "l_tax", "l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount"]
    whole = read("lineitem")
    holes = whole.select(*[F.when(F.col("l_orderkey") % (i + 2) > 0, F.col(c)).alias(c) for i, c in enumerate(numbers)])
    shuffles = {len(lines(L.spearman_matrix(df, cols), "Exchange")) for df in (whole, holes) for cols in (numbers[:3], numbers)}
    assert len(shuffles) == 1


def windows_over_one_partition(df):
    """Windows without a partition whose input is not the table of bucket totals."""
    text = plan(df).splitlines()
    found = []
    for i, x in enumerate(text):
        if re.search(r"Window \[", x) and "Exchange SinglePartition" in "".join(text[i:i + 4]):
            below = "".join(text[i:i + 12])
            if "_t_" not in below and "_last" not in below:
                found.append(x)
    return found


def test_no_row_level_window_in_one_task(spark, read):
    events = read("events")
    frames = [
        M.rolling_mean(events, "ts", "value", ["event_id"]), M.rolling_mean(events, "ts", "value", ["event_id"], ["user_id"]),
        M.autocorrelation(events, "value", "ts", "event_id"), L.spearman_matrix(read("lineitem"), ["l_quantity", "l_tax"]),
        T.kruskal_wallis(read("lineitem"), "l_returnflag", "l_quantity"), G.log_running_totals(calls(spark, SF)),
    ]
    for df in frames:
        assert windows_over_one_partition(df) == []


def test_whole_row_is_not_shuffled_for_the_duplicate_count(read):
    df = O.duplicate_row_count(read("documents"))
    exchange = lines(df, "Exchange hashpartitioning")
    assert len(exchange) == 1 and "text#" not in exchange[0] and exchange[0].count("#") == 2  # the two hashes


def test_histogram_is_one_scan_after_the_range(read):
    assert len(lines(U.histogram(read("lineitem"), ["l_tax", "l_quantity"]), "FileScan")) == 1


def test_no_python_on_the_row_path(read):
    lineitem = read("lineitem")
    for df in (moments(lineitem), C.value_counts(lineitem), O.duplicate_row_count(lineitem), U.histogram(lineitem, ["l_tax"]),
               T.kruskal_wallis(lineitem, "l_returnflag", "l_quantity").drop("p"), M.rolling_mean(read("events"), "ts", "value", ["event_id"])):
        assert "Python" not in plan(df) and "InPandas" not in plan(df)




def test_bucket_totals_do_not_repeat_the_large_shuffle(spark, read):
    events, lineitem = read("events"), read("lineitem")
    rolling = plan(M.rolling_mean(events, "ts", "value", ["event_id"]))
    assert len(re.findall(r"Exchange hashpartitioning\(_slot#\d+L, _b__t#\d+, _t#\d+L", rolling)) == 1
    df = T.kruskal_wallis(lineitem, "l_returnflag", "l_quantity").drop("p")
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_no_exchange_carries_the_texts_of_a_column(read, monkeypatch):
    plans, write = [], frequency.materialize
    monkeypatch.setattr(frequency, "materialize", lambda df, name: plans.append(df) or write(df, name))
    docs = read("documents").select("text", "source")
    for top in (3, 5_000):
        plans.clear()
        C.value_counts(docs, top=top)
        large = lines(plans[0], "Exchange hashpartitioning(column")
        assert large and all(not re.search(r"\bs#|text#", x) for x in large)
    assert frequency.top_values(docs, ["text"], 2).count() == 2


def test_filter_of_repeated_rows_prunes_the_rows(read):
    text = plan(O.duplicate_rows(read("documents").select("text", "lang")))
    assert "bit_get" in text and "BroadcastHashJoin" in text


def test_texts_are_not_shuffled_to_count_them(read):
    df = C.cardinality(read("documents"))
    assert all("s#" not in x for x in lines(df, "Exchange hashpartitioning(column"))
    assert "SortAggregate" not in plan(df)
