from quarry.plans import catalog


def test_context_counts_short_names_and_addresses(spark, small, tmp_path):
    spark.createDataFrame([(1, "A1", "Li", None), (2, "A1", "Acme Land, LLC", "x"), (3, "A1", None, "12 Oak St."), (4, "A1", "Birch Homes", "9 Elm Ave")], "lead_id long, application_number string, applicant_name string, project_address string").write.parquet(f"{tmp_path}/opportunity.parquet")
    text = "The request of ACME LAND LLC at 12 Oak St was heard by Ms. Li."
    spark.read.parquet(f"{small}/investigation_evidence.parquet").limit(1).selectExpr("* except (evidence_id, entity_identifier, evidence_text)", "7L as evidence_id", "'a1 ' as entity_identifier", f"'{text}' as evidence_text").write.parquet(f"{tmp_path}/investigation_evidence.parquet")
    got = catalog.queries()["context_join"](spark, str(tmp_path)).collect()
    assert sorted(r["lead_id"] for r in got) == [1, 2, 3]


def test_overlay_keeps_every_customer(spark, small):
    keys = {r["k"] for r in catalog.queries()["state_overlay"](spark, small).collect()}
    assert keys >= {r["c_custkey"] for r in spark.read.parquet(f"{small}/customer.parquet").select("c_custkey").collect()}


def test_payload_decodes_to_the_whole_text(spark, small):
    got = catalog.queries()["blob_digest"](spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet").where("text is not null").select("doc_id", "text")
    assert got.join(docs, "doc_id").where("decode(unbase64(payload), 'UTF-8') = text").count() == docs.count() > 0
