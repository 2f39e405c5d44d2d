"""Every registered query against its DuckDB SQL on the smallest tables, and under another partitioning."""

import duckdb
import pandas as pd
import pytest

from cantus import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(df: pd.DataFrame) -> pd.DataFrame:
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        if hasattr(v, "item") and not isinstance(v, pd.Timestamp):
            v = v.item()
        return f"{v + 0.0:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return df.map(one).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    got, want = norm(registry.queries()[name](spark, SF).toPandas()), norm(duck.sql(registry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("name", ["drops_topk", "cross_section", "merge_notes", "onset_match", "motif_labels", "vocal_chain", "bass_chain", "valley_pick"])
def test_partitions_dont_matter(spark, name):
    q = registry.queries()[name]
    out = []
    for n in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(norm(q(spark, SF).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    pd.testing.assert_frame_equal(*out)


#: Queries without SQL: difflib decides, or they are chains of steps that have SQL each; what must hold of their rows.
RULES = {
    "token_similarity": lambda p: p["similarity"].between(0, 1).all() and (p.loc[(p["a"] == p["b"]) & (p["a"] != ""), "similarity"] == 1).all(),
    "sequence_alignment": lambda p: p.dropna().groupby(["song", "line_idx"])["partner"].apply(lambda x: x.is_monotonic_increasing and x.is_unique).all(),
    "line_merge": lambda p: (p["end_s"] >= p["start_s"]).all() and p["confidence"].isin([0.65, 1.0]).all() and (p["confidence"] == 1).mean() > 0.5,
    "forced_alignment": lambda p: p["confidence"].isin([0.65, 0.9]).all() and (p["confidence"] == 0.9).mean() > 0.6,
    "vocal_chain": lambda p: p["midi"].notna().all() and (p["offset_s"] >= p["onset_s"]).all(),
    "bass_chain": lambda p: p["velocity"].between(0, 1).all() and (p["offset_s"] > p["onset_s"]).all(),
    "tracked_chains": lambda p: set(p["layer"]) == {"vocals", "bass"} and (p["offset_s"] > p["onset_s"]).all(),
    "song_boundaries": lambda p: (p.groupby("track")["t"].min() == 0).all() and (p.sort_values(["track", "t"]).groupby("track")["t"].diff().dropna() >= 12).all(),
    "notes_from_pitch": lambda p: (p["offset_s"] - p["onset_s"] >= 1.5).all() and p["velocity"].between(0, 1).all(),
}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rules(spark, name):
    rows = registry.queries()[name](spark, SF).toPandas()
    assert len(rows) and RULES[name](rows)
