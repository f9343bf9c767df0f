"""Rules, severities and policies."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import rulebook as R


def test_policies_switch_rules(spark):
    book = R.Rulebook()
    book.rule("short")(lambda: F.char_length("text") < 3)
    book.rule("loud", R.WARNING)(lambda: F.col("text").endswith("!"))
    df = spark.createDataFrame([(1, "a!"), (2, "long!"), (3, None), (4, "fine")], "i int, text string")
    see = lambda policy: {r.i: (r.errors, r.warnings, r.passed) for r in book.judge(df, policy).collect()}
    assert see(R.Policy()) == {1: (["short"], ["loud"], False), 2: ([], ["loud"], True), 3: ([], [], True), 4: ([], [], True)}
    assert see(R.Policy(frozenset(["short"]), {"loud": R.ERROR})) == {1: (["loud"], [], False), 2: (["loud"], [], False), 3: ([], [], True), 4: ([], [], True)}
    assert book.codes() == ["short", "loud"]
    for bad in (R.Policy(frozenset(["none"])), R.Policy(severity={"none": R.ERROR})):
        with pytest.raises(ValueError):
            book.judge(df, bad)
    with pytest.raises(ValueError):
        book.rule("short")(lambda: F.lit(True))
    with pytest.raises(ValueError):
        book.rule("x", "fatal")


def test_given_hashes_and_owners(spark):
    good = "sha256:2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    fields = "record_id string, source_id string, text string, domain string, language string, tone string, task_family string, allowed_for_training boolean, allowed_for_rag boolean, content_hash string"
    rows = [("rec", "src", "hello", "d", "en", None, "routing", True, False, h) for h in (good, f"\t{good}\n", good.upper(), good[:-1] + "5", None)]
    rows.append(("\tr ", None, " \n", None, "e", "\t", "x", None, True, "sha256:"))
    got = [(r.errors, r.warnings) for r in R.training_rules().judge(spark.createDataFrame(rows, fields)).collect()]
    assert got == [([], []), ([], []), (["hash_format"], []), ([], ["hash_of_text"]), (["hash_format"], []), (["record_id", "source_id", "text", "domain", "language", "tone", "task_family", "use_flags", "hash_format"], [])]
    memory = spark.createDataFrame([("PLAYER_PRIVATE", None, 1, "t"), ("PLAYER_PRIVATE", "ann", None, "t"), ("DM_PRIVATE", "", 0, " "), (None, None, 1, "t")], "scope string, owner_id string, sequence_number int, text string")
    assert [r.errors for r in R.memory_rules().judge(memory).collect()] == [["owner"], [], ["sequence", "text"], ["scope"]]
