import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagelens.functions import text as T
from pagelens.operators import ledger as L
from pagelens.operators import texts as J
from pagelens.sources import codecs
from tests.oracle_check import rows_of

OUT_SFX = "フー．．． ピクッ ーー ドキドキドキ ぴくぴくっ ガッタンゴットン ヒ．．．ッ！？".split()
OUT_TALK = "それは．．． ちょっと".split()
IN_SFX = ("ドキッ はぁっ ハッ ズドンッ ガシャッ パチンッ ゴクッ どきっ びくっ ぴくっ ごくっ がくっ ふわっ どきどき はぁはぁ ぐちゅぐちゅ "
          "ヒッ ドキッ！ ドキッ！？ ゴクッ．．． ガシャッ．．． ズドンッ！ パチンッ！").split()
IN_TALK = ("サッカー こんにちは うう．．． んっ ええっ ええっ！？ うんっ だめっ いやっ まてっ うそっ なにっ ちょっ そこっ はいっ ねえっ もうっ やめっ うわっ "
           "やだっ あーっ ふぇっ ダメッ ハイッ ウンッ ムリッ オイッ マテッ ナニッ ウソッ イヤッ ヤダッ ヤメッ ヒ．．．ッ！？ ヒッ！？ ヒ．．．ッ ア．．．ッ ウ．．．ッ！？ キャ．．．ッ").split()


def test_label_golden(spark):
    rows = [(t, False, "SFX") for t in OUT_SFX] + [(t, False, "DIALOGUE") for t in OUT_TALK]
    rows += [(t, True, "SFX") for t in IN_SFX] + [(t, True, "DIALOGUE") for t in IN_TALK]
    assert len(rows) == 71
    got = J.label_regions(spark.createDataFrame(rows, "src_text string, in_parent boolean, want string"))
    assert [tuple(r) for r in got.filter("label <> want").collect()] == []


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "s string").select(fn(F.col("s"))).first()[0]


def test_pause_between_kana(spark):
    for s in "ヒ．．．ッ キャ．．．ッ ア．．．ッ".split():
        assert one(spark, s, T.is_broken)
    for s in "フー．．． ゴクッ．．． ドキッ ヒッ ー．．． ハッ".split():
        assert not one(spark, s, T.is_broken)


def test_symbols(spark):
    yes = "．．． 。。。 ！？ ♥ ♡ ♪ ☆ 〜 ～ … ・・・ ー．．． ？ ．．．♥".split()
    no = ["ぁ", "ん", "ッ", "な．．．", "そん．．．", "でも、", "俺も", "ヒ．．．ッ！？", "A", "1", "", "   "]
    df = spark.createDataFrame([(s, True) for s in yes] + [(s, False) for s in no], "s string, want boolean")
    assert df.filter(T.symbols_only(F.col("s")) != F.col("want")).count() == 0
    for s, want in {"．．．": "...", "。。。": "...", "！？": "!?", "♥": "♥", "〜": "~", "…": "...", "？": "?", "．．．♥": "...♥"}.items():
        assert one(spark, s, T.symbols_as_text) == want


def test_clean_and_restore(spark):
    assert one(spark, "．．．", T.clean_answer) == ""
    assert one(spark, "ずっと〜", T.clean_answer).endswith("~")
    assert one(spark, "　. シ ズ ク…", T.clean_answer) == "シ ズ ク..."
    assert one(spark, "＼My apologies", T.clean_answer) == "My apologies"
    assert one(spark, "I love you", lambda c: T.restore_symbol(F.lit("大好き♥"), c)) == "I love you♥"


def test_missing_and_merged_answers(spark):
    items = spark.createDataFrame([(1, i, "x") for i in range(4)], "page_id int, region_id int, src_text string")
    got = spark.createDataFrame([(1, 0, "OK"), (1, 1, "   "), (1, 2, "．．．")], "page_id int, region_id int, text string")
    assert sorted(r.region_id for r in J.missing_answers(items, got).collect()) == [1, 2, 3]
    replies = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 1, "b"), (1, 0, 1, "no"), (1, 1, 2, " ")], "page_id int, region_id int, round int, text string")
    asked = spark.createDataFrame([(1, 1, 1, "missing"), (1, 1, 2, "missing")], "page_id int, region_id int, round int, kind string")
    assert sorted((r.region_id, r.text) for r in J.merge_answers(replies, asked).collect()) == [(0, "a"), (1, "b")]


def report(spark, rows):
    return spark.createDataFrame(
        [(1, i, *r) for i, r in enumerate(rows)], "page_id bigint, region_id bigint, label string, src_text string, translation string, route string, residue boolean, overflowed boolean")


NOTES = "page_id bigint, seq bigint, level string, tag string, msg string"


def severity(spark, rows, notes=()):
    n = spark.createDataFrame(list(notes), NOTES)
    counts = L.page_counts(report(spark, rows), n).withColumn("run_id", F.lit(1))
    return L.diagnose(counts, n.withColumn("run_id", F.lit(1))).first()


def test_diagnosis(spark):
    talk, sound = ("DIALOGUE", "x", None, "flat", False, False), ("SFX", "x", None, "skip", False, False)
    dead = severity(spark, [talk] * 15, [(1, 1, "error", "translate", "quota")])
    assert dead.severity == "dead" and dead.dead_names == "1" and "quota" in dead.error_lines
    assert severity(spark, [("DIALOGUE", "x", "y", "flat", False, False)] * 6).severity == "clean"
    assert severity(spark, [sound] * 4).severity == "clean"
    many = severity(spark, [sound], [(1, i, "error", "t", f"m{i // 2}") for i in range(16)])
    assert many.severity == "failed" and many.error_lines.endswith("; +10 more")


def test_large_page_is_one_report_row(spark):
    df = report(spark, [("SFX", "x", None, "skip", False, False)] * 5_001)
    notes = spark.createDataFrame([], NOTES)
    counts, ids = L.page_report(df, notes)
    assert [r.region_count for r in counts.collect()] == [5_001]
    assert sorted(r.region_id for r in ids.filter("kind = 'sfx_idx'").collect()) == list(range(5_001))
    assert L.report_documents(df, notes).count() == 1


def test_break_points_and_requests(spark):
    w = spark.createDataFrame([("banana",), ("sky",), ("a",)], "word string")
    assert {r.word: r.points for r in J.break_points(w).collect()}["banana"] == [2]
    items = spark.createDataFrame([(1, i, f'say "{i}"') for i in range(120)], "page_id bigint, region_id bigint, src_text string")
    rows = J.build_requests(items).collect()
    assert sorted(r.n for r in rows) == [20, 50, 50]
    import json
    assert json.loads(min(rows, key=lambda r: r.chunk).payload)["3"] == 'say "3"'


def test_notes_round_trip(spark):
    df = spark.createDataFrame([("  [!!] [translate] lost", ), ("[!] [budget] tight",), ("plain line",)], "value string")
    assert [tuple(r) for r in codecs.parse_notes(df).collect()] == [("error", "translate", "lost"), ("warn", "budget", "tight")]


def test_cjk_wraps_by_character(spark):
    df = spark.createDataFrame([("かなかなかな", 10, 100, 10), ("to be", 10, 100, 10)], "text string, box_w int, box_h int, size int")
    got = {r.text: r.lines for r in J.wrap(df).collect()}
    assert got == {"かなかなかな": 6, "to be": 2}


def test_answers_are_judged_with_hyphens(spark):
    rows = [(1, 1, "contractors", 30, 40), (1, 2, "contractors", 30, 10), (1, 3, "strengths", 20, 90), (1, 4, " ", 1, 1), (1, 5, "go on", 40, 20)]
    df = spark.createDataFrame(rows, "page_id bigint, region_id bigint, answer string, box_w int, box_h int").selectExpr("*", "5 AS soft", "9 AS hard", "4 AS word_hard")
    got = {r.region_id: (r.violates, r.over_hard, r.over_word) for r in J.violations(df.select("page_id", "region_id", "answer"), df.drop("answer"), F.lit(8)).collect()}
    assert got == {1: (False, True, True), 2: (True, True, True), 3: (True, False, True), 5: (False, False, False)}


def test_rows_of_their_own_width(spark):
    df = spark.createDataFrame([("aa aa aa", [12, 40, 12], 10), ("aa aa aa", [12, 20], 10), ("aaaa", [10, 90], 10)], "text string, rows array<int>, size int")
    assert [(r.lines, r.fits) for r in J.wrap_rows(df).collect()] == [(2, True), (3, False), (1, False)]


def test_glossary_join_with_repeated_ids_many_parts_and_wide_letters(spark, monkeypatch):
    """Equal to looking for every term in every text, where an identifier or none stands on several texts."""
    texts = [(1, "the 漢字 and 😀x", "THE"), (1, "other text", "und"), (None, "the end", None), (2, None, "x"), (3, "", "x"), (4, "é", "É e")]
    terms = [("the", "THE"), ("漢", "kan"), ("😀x", "smile"), ("x", "x"), ("", "none"), ("é", "É"), ("end", None), ("text", "UND"), ("the", "other"), ("text", "UND")]
    want = sorted(str((d, t, None if a is None or r is None else r.lower() in a.lower())) for d, s, a in texts for t, r in set(terms) if t and s is not None and t in s)
    for in_place, a_part in ((500, 3), (0, 3), (0, 100)):
        monkeypatch.setattr(J, "TERMS_IN_PLACE", in_place)
        monkeypatch.setattr(J, "TERMS_A_PART", a_part)
        got = J.glossary_join(spark.createDataFrame(texts, "doc_id bigint, src_text string, answer string"), spark.createDataFrame(terms, "term string, rendering string"))
        assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_fit_sizes_halving_equals_every_size(spark):
    rows = [(k, "ab cdefg hij " * (k % 7) + "klmnop" * (k % 3), 40 + 37 * k % 300, 20 + 53 * k % 280) for k in range(60)]
    texts = spark.createDataFrame(rows, "k int, text string, box_w int, box_h int")
    for lo, hi in ((6, 30), (5, 5), (1, 8)):
        got = {r.k: r.best_size for r in J.fit_sizes(texts, lo, hi).collect()}
        one = [J.fit_sizes(texts, z, z).select("k", "best_size") for z in range(lo, hi + 1)]
        best = {}
        for df in one:
            for r in df.collect():
                best[r.k] = max(best.get(r.k, 0), r.best_size)
        assert got == best


def test_text_duplicates_with_empty_texts_and_ids_beyond_doubles(spark, tmp_path):
    top = 2**63 - 8  # ...800, the first identifier of a page that doubles cannot tell from the one before
    rows = [(0, ""), (1, "a"), (2, "ab"), (3, ""), (4, None), (100, ""), (200, ""), (201, "b"), (-1, "a"), (-99, "ab"), (-100, "a"), (-101, "ab"),
            (top - 1, "a"), (top, "ab"), (top + 1, "abc"), (top - 2, "abc")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = con.execute(entry.oracle_sql()["text_duplicates"])
    want = rows_of([d[0] for d in found.description], found.fetchall())
    df = entry.queries()["text_duplicates"](spark, str(tmp_path))
    assert rows_of(df.columns, df.collect()) == want
    large = J.text_duplicates(spark.createDataFrame(rows, "region_id long, text string").withColumn("page_id", F.expr("region_id DIV 100")), limit=1)
    assert rows_of(large.columns, large.collect()) == want
