"""Statuses read from texts."""

from __future__ import annotations

from quillwork.plans import registry

SAID = {
    "Work is blocked by access": "blocked",
    "not blocked, work continues": "in_progress",
    "All done": "complete",
    "will be done later": "in_progress",
    "The slides will be done later. The report is done.": "complete",
    "never finished, still waiting for sign-off": "awaiting",
    "has not started": "not_started",
    "": "in_progress",
    None: "in_progress",
}


def test_status_is_read_from_the_turns_of_conversations(spark, tmp_path):
    spark.createDataFrame([(i // 4, i % 4, "user", text) for i, text in enumerate(SAID)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = registry.QUERIES["status_from_text"](spark, str(tmp_path)).collect()
    assert {(r.conv_id, r.turn): r.status for r in found} == {(i // 4, i % 4): status for i, status in enumerate(SAID.values())}
