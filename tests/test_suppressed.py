from marginalia.plans.entries import suppressed_names


def test_flags_follow_the_rules(spark, tmp_path):
    rows = [("g", "e", 0, "Chess", 4), ("g", "f", 0, "CHESS", 1), ("h", "e", 0, "Chess", 1), ("g", "e", 1, "anna", 1), ("g", "e", 2, "Anna", 1), ("g", "f", 1, "Anna", 1)]
    spark.createDataFrame(rows, "group_id string, episode_uuid string, pos int, name string, entity_type_id int").write.parquet(f"{tmp_path}/extracted_entities.parquet")
    got = {tuple(r)[:3] for r in suppressed_names(spark, str(tmp_path)).where("suppressed").collect()}
    assert got == {("g", "e", 0), ("g", "f", 0), ("g", "e", 1), ("g", "e", 2)}
