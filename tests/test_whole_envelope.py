"""duck_envelope_bins over every document, against its SQL without the cut to the first 60 ids."""

import duckdb

from reelframe.plans import registry

SF = "/root/testdata/sf0.001"


def test_envelope_of_every_document(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    whole = registry.oracle_sql()["duck_envelope_bins"].replace("WHERE doc_id < 60", "")
    want = con.sql(f"SELECT doc_id, bin, gain FROM ({whole})").fetchall()
    got = registry.queries()["duck_envelope_bins"](spark, SF).select("doc_id", "bin", "gain").collect()
    assert sorted(map(tuple, got)) == sorted(want) and max(r.doc_id for r in got) >= 60
