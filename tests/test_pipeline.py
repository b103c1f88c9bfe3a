from quarry.plans import pipeline

PACKET = """AGENDA
ITEM 1 PLRZ20230001 Acme Land LLC requests a zone map amendment from R-1 to C-2. The site is located at 12 Oak St.
PLRZ20230001 was denied on March 5, 2024. A public hearing is set for August 12, 2026 at 6:00 PM.
ITEM 2 PLSUB20240002 Birch Homes requests a subdivision of four lots. The site is located at 9 Elm Ave.
PLSUB20240002 was continued to August 20, 2026 by the planning commission.
"""


def test_chain_keeps_items_apart(spark):
    packets = spark.createDataFrame([(1, PACKET), (2, ""), (3, None)], "doc_id long, text string")
    rows = {r["application_number"]: r for r in pipeline.run(packets, "2026-08-01").collect()}
    assert set(rows) == {"PLRZ20230001", "PLSUB20240002"}
    first, second = rows["PLRZ20230001"], rows["PLSUB20240002"]
    assert first["signals"] == ["denied"] and second["signals"] == ["continued"]
    assert str(first["next_date"]) == "2026-08-12" and first["next_time"] == "6:00 PM" and first["days_until_event"] == 11
    assert first["priority"] == "HIGH" and first["urgency"] == "SOON"
    assert str(second["next_date"]) == "2026-08-20" and first["project_address"] == "12 Oak St"


def test_empty_packets(spark):
    assert pipeline.run(spark.createDataFrame([], "doc_id long, text string"), "2026-08-01").count() == 0


def test_partitioning_changes_nothing(spark):
    packets = spark.createDataFrame([(i, PACKET.replace("2023000", f"2023{i:03d}")) for i in range(5)], "doc_id long, text string")
    a = sorted(map(str, pipeline.run(packets, "2026-08-01").collect()))
    b = sorted(map(str, pipeline.run(packets.repartition(3), "2026-08-01").collect()))
    assert a == b and a


WHOLE = """NOTICE. A public hearing is set for September 9, 2026 at 7:00 PM.
Minutes: Acme Land LLC appealed the decision. The request of Acme Land LLC was denied on May 6, 2025.
ITEM 2 PLRZ20230001 Acme Land LLC requests a zone map amendment from R-1 to C-2.
ITEM 5 PLSUB20240002 Birch Homes requests a subdivision of four lots.
ITEM 2 Staff report. The site is located at 12 Oak St. The applicant filed an amended application naming 12 Oak St. The planning commission meets on August 20, 2026.
"""


def test_items_keep_their_printed_number_and_the_preamble(spark):
    packets = spark.createDataFrame([(1, WHOLE)], "doc_id long, text string")
    assert sorted((r["item"] or 0, r["start"]) for r in pipeline.items(packets).collect()) == sorted([(0, 0), *((int(n), WHOLE.index(f"ITEM {n} {w}")) for n, w in ((2, "PLRZ"), (5, "PLSUB"), (2, "Staff")))])


def test_repeated_items_preamble_and_rest_of_the_packet_count(spark):
    rows = {r["application_number"]: r for r in pipeline.run(spark.createDataFrame([(1, WHOLE)], "doc_id long, text string"), "2026-08-01").collect()}
    first, second = rows["PLRZ20230001"], rows["PLSUB20240002"]
    assert first["signals"] == ["amended", "appeal", "denied"] and second["signals"] == []
    assert first["project_address"] == "12 Oak St" and str(first["next_date"]) == "2026-08-20"
    assert str(second["next_date"]) == "2026-09-09" and second["next_time"] == "7:00 PM" and second["has_future"]
