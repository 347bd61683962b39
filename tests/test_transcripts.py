from joblode.operators import transcripts as T

ROWS = [(1, 0, "user", "q", None), (1, 1, "assistant", None, ["top_skills", "get_job_details"]),
        (1, 2, "assistant", "Done", []), (2, 0, "assistant", "No jobs found", ["top_skills_all"]),
        (3, 0, "assistant", " \n", None)]


def talks(spark):
    return spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string, tool_calls array<string>")


def test_history(spark):
    rows = T.history(talks(spark), "Hi").orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["turn"], r["role"]) for r in rows][:2] == [(1, -1, "system"), (1, 0, "user")]
    assert len(rows) == 8


def test_answers_and_calls(spark):
    assert {r[0]: r[1] for r in T.final_answer(talks(spark)).collect()} == {
        1: "Done", 2: "No jobs found", 3: " \n"}
    rows = T.tool_calls(talks(spark)).orderBy("conv_id", "turn", "call").collect()
    assert [r["tool"] for r in rows] == ["top_skills", "get_job_details", "top_skills_all"]


def test_checks(spark):
    rows = {r["conv_id"]: tuple(r)[1:] for r in T.transcript_checks(
        talks(spark), "top_skills", ("get_job_details", "semantic_search_jobs")).collect()}
    assert rows == {1: (True, True, True, False), 2: (False, False, True, True),
                    3: (False, False, False, False)}
