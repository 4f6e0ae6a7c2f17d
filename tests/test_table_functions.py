import pytest

from residua.functions.table_functions import Runs, register_functions
from residua.operators.kmers import PIECE
from residua.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def known(spark):
    return register_functions(spark)


def test_pieces_hold_every_window_once(known):
    text = "".join("ACDEFGHIKL"[i * i % 10] for i in range(2 * PIECE + 5)) + "\nMK"
    for k in (1, 3, 7):
        rows = known.sql("""
            SELECT begin + pos AS at, kmer FROM (SELECT begin, kmers(piece, {k}) AS windows FROM (
              SELECT kmer_pieces({text}, {k}) AS pieces), LATERAL inline(pieces)), LATERAL inline(windows)""",
                         text=text, k=k).collect()
        assert sorted(map(tuple, rows)) == [(i, text[i:i + k]) for i in range(len(text) - k + 1)]
    assert known.sql("SELECT kmers('AC', 3), kmers('', 1), kmers(NULL, 1)").first()[:] == ([], [], None)


def test_frames_stop_and_unknown_bases(known):
    found = known.sql("SELECT frames('ATGTAACCNAC') AS f").first().f
    # GTNGGTTACAT is the other strand
    assert [tuple(r) for r in found] == [(0, "M"), (1, "CNX"), (2, "VTX"), (3, "XGY"), (4, "XVT"), (5, "XLH")]
    assert [r.aa for r in known.sql("SELECT frames('') AS f").first().f] == [""] * 6


def test_frames_are_cut_before_they_are_translated(known):
    # 300,000 codons behind an early stop, none before a late one, line ends between codons
    for text, first in (("ATGTAA" + "GCC" * 300_000, "M"), ("GCC" * 20_000 + "TGAGCC", "A" * 20_000), ("\nA\nACGT\rAA", "T")):
        assert known.sql("SELECT frames({t}) AS f", t=text).first().f[0].aa == first
        assert known.sql("SELECT frame_residues({t}, 0) AS aa", t=text).first().aa == first
    assert [r.aa for r in known.sql("SELECT frames(CAST(NULL AS STRING)) AS f").first().f] == [None] * 6


def test_frames_are_made_once_for_each_text(known, tmp_path):
    known.createDataFrame([(1, "ATG GCC"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = QUERIES["frame_lateral"](known, str(tmp_path))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("ArrowEvalPython") == 1
    assert frame.filter("doc_id = 2 AND aa IS NULL").count() == 6


def test_runs_follow_their_arguments(known):
    text = "AABCCC\U0001F600\U0001F600"
    assert [tuple(r) for r in known.sql("SELECT * FROM runs({t}, 2)", t=text).collect()] == [
        (0, "A", 2), (3, "C", 3), (6, "\U0001F600", 2)]
    assert known.sql("SELECT * FROM runs('ABB', 2, true)").columns == ["start", "letter", "length", "run"]
    assert known.sql("SELECT * FROM runs(NULL, 1)").count() == 0 and known.sql("SELECT * FROM runs('', 1)").count() == 0
    assert list(Runs().eval("AAA", 1, True)) == [(0, "A", 3, "AAA")]
    for wrong in ("runs('A', 0)", "runs(1, 1)", "runs('A', CAST(NULL AS INT))"):
        with pytest.raises(Exception, match="runs: "):
            known.sql(f"SELECT * FROM {wrong}").collect()


def test_lists_stay_in_the_task(known):
    frame = known.sql("SELECT id, pos, kmer FROM (SELECT id, kmers(repeat('AC', CAST(id AS INT)), 3) AS windows "
                      "FROM range(9)), LATERAL inline(windows)")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan
