"""Text and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.functions import fixed as X
from pagelens.functions import text as T
from pagelens.operators import texts as J
from pagelens.plans.registry import query

SP = X.SPACE


def quoted(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


FROM_ = "".join(X.SWAPPED) + X.DROPPED
TO = "".join(X.SWAPPED.values()).replace("'", "''")


def plain_sql(c: str) -> str:
    return f"replace(replace(translate({c}, '{FROM_}', '{TO}'), '…', '...'), '‥', '..')"


def squeeze_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SP}+', ' ', 'g'))"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{SP}+|{SP}+$', '', 'g')"


def clean_sql(c: str) -> str:
    return squeeze_sql(f"regexp_replace({plain_sql(c)}, '^[ .,:;\\-–—]+', '')")


def repeat_sql(c: str) -> str:
    return f"""(length({c}) >= 4 AND len(list_filter([0, 1, 2], lambda k: (k = 0 OR regexp_full_match(right({c}, k), '[っッー]+')) AND length({c}) - k >= 2
  AND len(list_filter(range(1, (length({c}) - k) // 2 + 1), lambda u: (length({c}) - k) % u = 0 AND repeat(left({c}, u), (length({c}) - k) // u) = left({c}, length({c}) - k)
      AND NOT regexp_full_match(left({c}, u), '[っッー]+'))) > 0)) > 0)"""


@query("gate_text", """
SELECT src, LENGTH(src) / 300e0 AS ink_ratio, CASE WHEN LENGTH(src) / 300e0 < 15e-3 OR text IN """ + quoted(X.INVENTED) + """ OR (length(text) >= 5 AND replace(text, left(text, 1), '') = '')
  THEN '' ELSE text END AS gated FROM kana""", "kana")
def _(c):
    ratio = F.length("src") / F.lit(300.0)
    return c.kana.select("src", ratio.alias("ink_ratio"), T.gated_text(F.col("text"), ratio).alias("gated"))


@query("script_flags", f"""
WITH k AS (SELECT *, regexp_replace(text, '[^{X.KANA}]', '', 'g') AS core FROM kana)
SELECT src, regexp_matches(text, '[{X.KANJI}]') AS kanji, core, translate(core, '{X.KATAKANA}', '{X.HIRAGANA}') AS hira, regexp_replace(core, '[っッー]+$', '') AS stem,
  regexp_matches(core, '[ァ-ヶ]') AND NOT regexp_matches(core, '[ぁ-ゖ]') AS katakana, {repeat_sql('core')} AS repeats,
  regexp_matches(text, '[{X.KANA}](?s:.*)[{X.PAUSE}](?s:.*)[{X.KANA}]') AS broken, regexp_matches(text, '[？?]') AS asks FROM k""", "kana")
def _(c):
    core = T.kana_core(F.col("text"))
    return c.kana.select(
        "src", T.has_kanji(F.col("text")).alias("kanji"), core.alias("core"), T.to_hiragana(core).alias("hira"), T.stem(core).alias("stem"),
        T.all_katakana(core).alias("katakana"), T.is_repeat(core).alias("repeats"), T.is_broken(F.col("text")).alias("broken"), T.asks(F.col("text")).alias("asks"))


LABEL_SQL = f"""k0 AS (SELECT src, text, in_parent, {strip_sql('text')} AS raw FROM kana),
k1 AS (SELECT *, regexp_replace(raw, '[^{X.KANA}]', '', 'g') AS core FROM k0),
k2 AS (SELECT *, translate(core, '{X.KATAKANA}', '{X.HIRAGANA}') AS hira, translate(regexp_replace(core, '[っッー]+$', ''), '{X.KATAKANA}', '{X.HIRAGANA}') AS root, {repeat_sql('core')} AS rep FROM k1),
lab AS (SELECT *, CASE WHEN raw = '' THEN 'DIALOGUE' WHEN regexp_matches(raw, '[{X.KANJI}]') OR core = '' OR core IN {quoted(X.DIALOGUE)} THEN 'DIALOGUE'
  WHEN NOT in_parent THEN CASE WHEN length(core) <= 3 THEN 'SFX' WHEN regexp_matches(core, '[っッー]') THEN CASE WHEN length(core) <= 8 THEN 'SFX' ELSE 'DIALOGUE' END
      WHEN rep OR core IN {quoted(X.SOUNDS)} THEN 'SFX' ELSE 'DIALOGUE' END
  WHEN hira IN {quoted(X.DIALOGUE)} OR (root <> '' AND root IN {quoted(X.DIALOGUE)}) THEN 'DIALOGUE'
  WHEN rep OR core IN {quoted(X.SOUNDS)} OR hira IN {quoted(X.SOUNDS)} THEN 'SFX'
  WHEN length(core) <= 6 AND regexp_matches(core, '[ァ-ヶ]') AND NOT regexp_matches(core, '[ぁ-ゖ]') AND regexp_matches(core, '[っッ]$')
     AND NOT (regexp_matches(raw, '[？?]') OR regexp_matches(raw, '[{X.KANA}](?s:.*)[{X.PAUSE}](?s:.*)[{X.KANA}]')) THEN 'SFX'
  WHEN root <> '' AND root || root IN {quoted(X.SOUNDS)} THEN 'SFX' ELSE 'DIALOGUE' END AS label FROM k2)"""


@query("label_regions", "WITH " + LABEL_SQL + " SELECT src, label, CASE WHEN label = 'SFX' THEN 6e-1 ELSE 5e-1 END AS label_conf FROM lab", "kana")
def _(c):
    return J.label_regions(c.kana.withColumnRenamed("text", "src_text")).select("src", "label", "label_conf")


@query("with_protection", """
SELECT page_id, region_id, label IN ('SFX', 'UNREADABLE') AS protected, label NOT IN ('SFX', 'UNREADABLE') AND src_text <> '' AS translatable,
  label NOT IN ('SFX', 'UNREADABLE') AND src_text <> '' AND coalesce(translation, '') = '' AS to_send FROM regions""", "regions")
def _(c):
    return J.with_protection(c.regions).select("page_id", "region_id", "protected", "translatable", "to_send")


@query("answer_symbols", f"""
SELECT src, {squeeze_sql(plain_sql('text'))} AS answer FROM kana WHERE {strip_sql('text')} <> '' AND NOT regexp_matches(text, '{X.WORDY}')""", "kana")
def _(c):
    return c.kana.filter(T.symbols_only(F.col("text"))).select("src", T.symbols_as_text(F.col("text")).alias("answer"))


@query("clean_answer", f"SELECT src, {clean_sql('text')} AS answer FROM kana", "kana")
def _(c):
    return c.kana.select("src", T.clean_answer(F.col("text")).alias("answer"))


RESTORE = f"""CASE WHEN o = '' THEN '' WHEN e IN {quoted(X.EMOTION)} AND NOT contains(o, e) THEN o || e ELSE o END"""


@query("restore_symbol", f"""
WITH a AS (SELECT src, text, replace(replace({strip_sql("'！' || src || ' '")}, '！', '!'), '？', '?') AS o, right(regexp_replace(text, '{SP}+$', ''), 1) AS e FROM kana)
SELECT src, {RESTORE} AS answer FROM a""", "kana")
def _(c):
    return c.kana.select("src", T.restore_symbol(F.col("text"), F.concat(F.lit("！"), "src", F.lit(" "))).alias("answer"))


@query("apply_case", "SELECT doc_id, CASE WHEN lang = 'en' THEN replace(replace(upper(text), 'ß', 'SS'), 'ẞ', 'SS') ELSE text END AS text FROM documents")
def _(c):
    return c.documents.select("doc_id", F.when(F.col("lang") == "en", F.upper("text")).otherwise(F.col("text")).alias("text"))


@query("build_requests", """
WITH r AS (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY region_id) - 1) // 50 AS chunk FROM regions WHERE label = 'DIALOGUE')
SELECT page_id // 16 AS page_id, chunk, count(*) AS n, CAST(sum(length(src_text)) AS BIGINT) AS chars, string_agg(region_id, ',' ORDER BY region_id) AS ids,
  '{' || string_agg('"' || region_id || '":"' || src_text || '"', ',' ORDER BY region_id) || '}' AS payload
FROM (SELECT page_id, region_id, src_text, (row_number() OVER (PARTITION BY page_id // 16 ORDER BY region_id) - 1) // 50 AS chunk FROM regions WHERE label = 'DIALOGUE') GROUP BY 1, 2""", "regions")
def _(c):
    items = c.regions.filter("label = 'DIALOGUE'").select(F.floor(F.col("page_id") / 16).alias("page_id"), "region_id", "src_text")
    return J.build_requests(items)


@query("missing_answers", f"""
WITH a AS (SELECT i.page_id, i.region_id, src_text, {strip_sql('r.text')} AS raw FROM replies r JOIN items i ON i.page_id = r.page_id AND i.region_id = r.region_id WHERE round = 0),
b AS (SELECT *, replace(replace(raw, '！', '!'), '？', '?') AS o, right(regexp_replace(src_text, '{SP}+$', ''), 1) AS e FROM a),
g AS (SELECT * FROM b WHERE raw <> '' AND {clean_sql(RESTORE)} <> '')
SELECT page_id, region_id FROM items i WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.page_id = i.page_id AND g.region_id = i.region_id)""", "items replies")
def _(c):
    return J.missing_answers(c.items, c.replies.filter("round = 0")).select("page_id", "region_id")


@query("merge_answers", """
SELECT r.page_id, r.region_id, arg_max(text, r.round) AS text, max(r.round) AS round FROM replies r LEFT JOIN asked a ON a.page_id = r.page_id AND a.region_id = r.region_id AND a.round = r.round
WHERE r.round = 0 OR kind = 'budget' OR (kind = 'missing' AND trim(text) <> '') GROUP BY 1, 2""", "replies asked")
def _(c):
    return J.merge_answers(c.replies, c.asked)


GLOSSARY = [("the", "THE"), ("tion", "TION"), ("les", "der"), ("und", "and"), ("que", "that"), ("ing ", "ing"), ("ung", "ung"), ("mente", "mente"), ("ç", "c"), ("worth", "value")]


@query("glossary_hits", "WITH g(term, rendering) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in GLOSSARY) + """)
SELECT doc_id, term, contains(lower(reverse(text)), lower(rendering)) AS used FROM documents JOIN g ON contains(text, term)""")
def _(c):
    return J.glossary_hits(c.documents.select("doc_id", F.col("text").alias("src_text"), F.reverse("text").alias("answer")), GLOSSARY)


TERMS = "SELECT DISTINCT split_part(text, ' ', 2) AS term, upper(split_part(text, ' ', 2)) AS rendering FROM {benchmark} UNION SELECT 'ç', 'c'"


@query("glossary_join", "WITH g AS (" + TERMS.replace("{benchmark}", "benchmark") + """)
SELECT doc_id, term, contains(lower(reverse(text)), lower(rendering)) AS used FROM documents JOIN g ON term <> '' AND contains(text, term)""")
def _(c):
    texts = c.documents.select("doc_id", F.col("text").alias("src_text"), F.reverse("text").alias("answer"))
    return J.glossary_join(texts, c.spark.sql(TERMS, benchmark=c.benchmark))


@query("text_metrics", f"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{SP}+'), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, length(text) AS chars, len(ws) AS words, coalesce(list_max(list_transform(ws, lambda x: length(regexp_replace(x, '[^A-Za-z'']', '', 'g')))), 0) AS longest_word,
  CAST(len(list_filter(string_split(text, chr(10)), lambda l: ends_with(l, '-'))) AS BIGINT) AS hyphen_lines, length(text) - length(regexp_replace(text, '[「」『』。、！？…・〜～]', '', 'g')) AS cjk_left FROM w""")
def _(c):
    return J.text_metrics(c.documents)


# Fixed coverage dims: the main font has ASCII, the fallback Latin-1, the CJK font kana and punctuation, the symbol font the rest.
RANGES = [("main", 0, 0x21, 0x7E), ("fallback", 1, 0xA1, 0xE9), ("cjk", 2, 0x3001, 0x30FE), ("cjk", 2, 0xFF01, 0xFF5E), ("symbol", 3, 0x2600, 0x266F), ("main", 0, 0x2661, 0x2665)]


def cmap(c):
    rows = c.spark.createDataFrame(RANGES, "font string, priority int, lo int, hi int")
    ch = F.decode(F.expr("unhex(lpad(hex(cp), 8, '0'))"), "UTF-32")
    return rows.select("font", "priority", F.explode(F.sequence("lo", "hi")).alias("cp")).select("font", "priority", ch.alias("ch"))


@query("coverage", f"""
WITH t AS (SELECT DISTINCT doc_id, unnest(string_split(text || '♥。', '')) AS ch FROM documents), u AS (SELECT * FROM t WHERE NOT regexp_full_match(ch, '{SP}?')),
m AS (SELECT DISTINCT font, priority, chr(CAST(unnest(range(lo, hi + 1)) AS INT)) AS ch FROM (VALUES {", ".join(f"('{f}', {p}, {a}, {b})" for f, p, a, b in RANGES)}) r(font, priority, lo, hi)),
p AS (SELECT u.doc_id, u.ch, font, priority FROM u LEFT JOIN m ON m.ch = u.ch WHERE font IS NULL OR font <> 'main' OR u.ch NOT IN {quoted(X.FORCED_SYMBOLS)})
SELECT u.doc_id, u.ch, arg_min(font, priority) AS font FROM u LEFT JOIN p ON p.doc_id = u.doc_id AND p.ch = u.ch GROUP BY 1, 2""")
def _(c):
    return J.coverage(c.documents.select("doc_id", F.concat("text", F.lit("♥。")).alias("text")), cmap(c))


WIDTH = """list_sum(list_transform(list_filter(string_split({w}, ''), lambda c: c <> ''), lambda c: CASE WHEN contains('iIl.,:;''!| ', c) THEN 3 WHEN contains('mwMW', c) THEN 9 WHEN regexp_matches(c, '\\p{{L}}') THEN 6 ELSE 5 END)) * 85"""


def fold_sql(ws: str, limit: str) -> str:
    """Fold over ``ws`` (list of widths, negative at the start of a line) prefixed with the initial state."""
    tight = f"w >= 0 AND s.used + 255 + w <= {limit}"
    return f"""list_reduce({ws}, lambda s, w: {{'lines': CASE WHEN s.used = 0 OR ({tight}) THEN s.lines ELSE s.lines + 1 END,
  'used': CAST(CASE WHEN s.used <> 0 AND {tight} THEN s.used + 255 + w ELSE abs(w) END AS BIGINT), 'ok': s.ok AND abs(w) <= {limit}}},
  {{'lines': 1, 'used': CAST(0 AS BIGINT), 'ok': true}})"""


def part_sql(a: str, b: str) -> str:
    return f"(CAST({WIDTH.format(w=f'w[{a} + 1:{b}]')} AS BIGINT) + CASE WHEN {b} < length(w) THEN 425 ELSE 0 END)"


BREAKS = """list_filter(range(1, length({w})), lambda i: regexp_matches({w}[i], '[AEIOUYaeiouy]') AND regexp_matches({w}[i + 1], '\\p{{L}}') AND NOT regexp_matches({w}[i + 1], '[AEIOUYaeiouy]')
  AND length(regexp_replace(left({w}, CAST(i AS INT)), '\\P{{L}}', '', 'g')) >= 2 AND length(regexp_replace({w}[i + 1:], '\\P{{L}}', '', 'g')) >= 3)"""


WORDS_OF = f"list_filter(regexp_split_to_array(@text@, '{SP}+'), lambda x: x <> '')"
DISTINCT_W = f"""dw AS (SELECT w, CAST({WIDTH.format(w='w')} AS BIGINT) AS width FROM (SELECT DISTINCT w FROM ws)),"""


def widths_sql(src: str, key: str, text: str) -> str:
    """``wd``: key and the ordered list of word widths."""
    return f"""ws AS (SELECT {key}, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT {key}, {WORDS_OF.replace("@text@", text)} AS l FROM {src})),
{DISTINCT_W}
wd AS (SELECT {key}, list(width ORDER BY pos) AS wl FROM ws JOIN dw USING (w) GROUP BY {key})"""


@query("wrap", "WITH " + widths_sql("boxed", "doc_id", "text") + f""",
f AS (SELECT b.doc_id, box_w, box_h, size, {fold_sql("coalesce(wl, CAST([] AS BIGINT[]))", "box_w * 1000 // size")} AS s FROM boxed b LEFT JOIN wd USING (doc_id))
SELECT doc_id, s.lines AS lines, s.used AS last_used, s.ok AND s.lines * size <= box_h AS fits FROM f""", "boxed")
def _(c):
    return J.wrap(c.boxed).select("doc_id", "lines", "last_used", "fits")


# An oval box: its middle rows are the widest.
ROOM = "coalesce(lm[{i}], 0)"


@query("wrap_rows", "WITH " + widths_sql("boxed", "doc_id", "text") + f""",
b AS (SELECT doc_id, coalesce(wl, CAST([] AS BIGINT[])) AS wl, list_transform(range(0, box_h // size), lambda k: (box_w - 4 * abs(2 * k - box_h // size)) * 1000 // size) AS lm FROM boxed LEFT JOIN wd USING (doc_id)),
f AS (SELECT doc_id, len(lm) AS n, list_reduce(wl, lambda s, w: CASE WHEN s.used <> 0 AND s.used + 255 + w <= {ROOM.format(i="s.lines")} THEN {{'lines': s.lines, 'used': CAST(s.used + 255 + w AS BIGINT), 'ok': s.ok}}
  WHEN s.used = 0 THEN {{'lines': s.lines, 'used': CAST(w AS BIGINT), 'ok': s.ok AND w <= {ROOM.format(i="s.lines")}}} ELSE {{'lines': s.lines + 1, 'used': CAST(w AS BIGINT), 'ok': s.ok AND w <= {ROOM.format(i="s.lines + 1")}}} END,
  {{'lines': 1, 'used': CAST(0 AS BIGINT), 'ok': true}}) AS s FROM b)
SELECT doc_id, s.lines AS lines, s.ok AND s.lines <= n AS fits FROM f""", "boxed")
def _(c):
    n = F.floor(F.col("box_h") / F.col("size")).cast("int")
    rows = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.col("box_w") - 4 * F.abs(2 * k - n))).otherwise(F.array().cast("array<int>"))
    return J.wrap_rows(c.boxed.withColumn("rows", rows)).select("doc_id", "lines", "fits")


LINES = "SELECT conv_id, turn, text, CAST(120 + (conv_id * 13 + turn * 31) % 260 AS INT) AS box_w, CAST(80 + (conv_id * 7 + turn * 17) % 300 AS INT) AS box_h FROM {conversations}"


@query("fit_sizes", "WITH li AS (" + LINES.replace("{conversations}", "conversations") + ")," + widths_sql("li", "conv_id, turn", "text") + f""",
g AS (SELECT conv_id, turn, box_w, box_h, wl, unnest(range(6, 31)) AS z FROM li JOIN wd USING (conv_id, turn)),
f AS (SELECT *, {fold_sql("wl", "box_w * 1000 // z")} AS s FROM g)
SELECT conv_id, turn, CAST(coalesce(max(z) FILTER (s.ok AND s.lines * z <= box_h), 0) AS INT) AS best_size FROM f GROUP BY 1, 2""")
def _(c):
    return J.fit_sizes(c.spark.sql(LINES, conversations=c.conversations), 6, 30).select("conv_id", "turn", "best_size")


def _budget_rows():
    return ", ".join(f"{{'w': {J.sum_width(w)}, 'n': {len(w)}}}" for w in X.FILLER.split())


def budget_sql(name: str, size: str) -> str:
    """Characters and word letters that fit ``det`` boxes at ``size``: page_id, det_id, z, cb, wb."""
    letters = ", ".join(str(J.sum_width(X.LONG_WORD[:n])) for n in range(2, 25))
    line = "CASE WHEN s.used = 0 OR s.used + 255 + w.w <= lim THEN s.lines ELSE s.lines + 1 END"
    go = f"s.go AND w.w <= lim AND {line} <= nr"
    return f"""{name}_l AS (SELECT page_id, det_id, z, (x2 - x1) * 1000 // z AS lim, (y2 - y1) // z AS nr FROM (SELECT *, {size} AS z FROM det)),
{name}_k AS (SELECT lim, nr, list_reduce([{_budget_rows()}], lambda s, w: {{'lines': {line},
  'used': CAST(CASE WHEN s.used = 0 THEN w.w WHEN s.used + 255 + w.w <= lim THEN s.used + 255 + w.w ELSE w.w END AS BIGINT),
  'chars': CASE WHEN {go} THEN s.chars + w.n + CASE WHEN s.chars > 0 THEN 1 ELSE 0 END ELSE s.chars END, 'go': {go}}},
  {{'lines': 1, 'used': CAST(0 AS BIGINT), 'chars': 0, 'go': true}}).chars AS cb FROM (SELECT DISTINCT lim, nr FROM {name}_l)),
{name} AS (SELECT page_id, det_id, z, cb, CAST(coalesce(list_max(list_filter(range(2, 25), lambda n: [{letters}][n - 1] <= lim AND nr >= 1)), 0) AS INT) AS wb
  FROM {name}_l JOIN {name}_k USING (lim, nr))"""


def _budget_boxes(c):
    return c.det.select("page_id", "det_id", "score", (F.col("x2") - F.col("x1")).alias("box_w"), (F.col("y2") - F.col("y1")).alias("box_h"))


@query("budgets", "WITH " + budget_sql("b", "7 + score % 9") + " SELECT page_id, det_id, z AS size, cb AS char_budget, wb AS word_budget FROM b", "det")
def _(c):
    return J.budgets(_budget_boxes(c), 7 + F.col("score") % 9).select("page_id", "det_id", "size", "char_budget", "word_budget")


@query("region_budgets", "WITH " + budget_sql("s", "12 + score % 17") + "," + budget_sql("h", "7 + score % 3") + """
SELECT page_id, det_id, s.z AS cap, s.cb AS soft, h.cb AS hard, s.wb AS word_soft, h.wb AS word_hard FROM s JOIN h USING (page_id, det_id)""", "det")
def _(c):
    b = J.region_budgets(_budget_boxes(c), 12 + F.col("score") % 17, 7 + F.col("score") % 3)
    return b.select("page_id", "det_id", "cap", "soft", "hard", "word_soft", "word_hard")


LIMITS = """SELECT CAST(FLOOR(conv_id / 20e0) AS BIGINT) AS page_id, conv_id * 100 + turn AS region_id, text AS answer, CAST(120 + (conv_id * 13 + turn * 31) % 260 AS INT) AS box_w,
  CAST(80 + (conv_id * 7 + turn * 17) % 300 AS INT) AS box_h, CAST(100 + conv_id % 300 AS INT) AS soft, CAST(200 + conv_id % 400 AS INT) AS hard, CAST(9 + turn % 4 AS INT) AS word_hard FROM {conversations}"""


@query("violations", "WITH li AS (" + LIMITS.replace("{conversations}", "conversations") + f"), cl AS (SELECT *, replace(replace(upper({clean_sql('answer')}), 'ß', 'SS'), 'ẞ', 'SS') AS tx FROM li)," + widths_sql("cl", "page_id, region_id", "tx") + f""",
wx AS (SELECT page_id, region_id, pos, w, width, box_w * 1000 // 11 AS lim FROM ws JOIN dw USING (w) JOIN cl USING (page_id, region_id)),
st AS (SELECT w, lim, list_reduce([{{'st': 0::BIGINT, 'ok': 0::BIGINT, 'pt': CAST([] AS BIGINT[]), 'good': true}}] || list_transform(list_append({BREAKS.format(w="w")}, length(w)), lambda p: {{'st': 0::BIGINT, 'ok': p::BIGINT, 'pt': CAST([] AS BIGINT[]), 'good': true}}),
  lambda s, q: CASE WHEN {part_sql("s.st", "q.ok")} <= lim THEN {{'st': s.st, 'ok': q.ok, 'pt': s.pt, 'good': s.good}}
  WHEN s.ok > s.st AND {part_sql("s.ok", "q.ok")} <= lim THEN {{'st': s.ok, 'ok': q.ok, 'pt': list_append(s.pt, {part_sql("s.st", "s.ok")}), 'good': s.good}}
  ELSE {{'st': s.st, 'ok': s.ok, 'pt': s.pt, 'good': false}} END) AS s FROM (SELECT DISTINCT w, lim FROM wx WHERE width > lim)),
pt AS (SELECT w, lim, CASE WHEN s.good THEN list_append(s.pt, {part_sql("s.st", "length(w)")}) END AS l FROM st),
wd2 AS (SELECT page_id, region_id, flatten(list(CASE WHEN pt.l IS NULL THEN [width] ELSE [-pt.l[1]] || pt.l[2:] END ORDER BY pos)) AS wl FROM wx LEFT JOIN pt ON pt.w = wx.w AND pt.lim = wx.lim GROUP BY ALL),
f AS (SELECT cl.*, {fold_sql("wl", "box_w * 1000 // 11")} AS s, list_max(list_transform({WORDS_OF.replace("@text@", "tx")}, lambda x: length(regexp_replace(x, '[^A-Z'']', '', 'g')))) AS lw FROM cl JOIN wd2 USING (page_id, region_id) WHERE tx <> '')
SELECT page_id, region_id, length(tx) AS chars, NOT (s.ok AND s.lines * 11 <= box_h) AS violates, length(tx) > soft AS over_soft, length(tx) > hard AS over_hard, lw > word_hard AS over_word,
  CASE WHEN NOT (s.ok AND s.lines * 11 <= box_h) THEN length(tx) || ' chars get cut off; holds about ' || soft || ' characters and words up to ' || word_hard || ' letters' END AS message FROM f""")
def _(c):
    li = c.spark.sql(LIMITS, conversations=c.conversations)
    return J.violations(li.select("page_id", "region_id", "answer"), li.drop("answer"), F.lit(11))


SIZES = """SELECT page_id, det_id AS region_id, cls = 1 AS hyphenated, size, size * (CASE WHEN cls = 1 THEN 7 ELSE 9 END) <= score AS fits, (score * 7 + size * 13) % 50 AS balance FROM
  (SELECT page_id, CAST(FLOOR(det_id / 40e0) AS BIGINT) AS det_id, cls, MAX(score) AS score FROM {det} WHERE cls <> 0 GROUP BY 1, 2, 3) d {grid}"""


@query("choose_size", "WITH c AS (" + SIZES.replace("{det}", "det").replace("{grid}", ", (SELECT CAST(unnest(range(6, 41)) AS INT) AS size) s") + """),
b AS (SELECT page_id, region_id, max(size) FILTER (NOT hyphenated) AS p, max(size) FILTER (hyphenated) AS h FROM c WHERE fits GROUP BY ALL),
w AS (SELECT page_id, region_id, NOT (p IS NOT NULL AND (h IS NULL OR p >= h * 75e-2)) AS hyphenated, CASE WHEN p IS NOT NULL AND (h IS NULL OR p >= h * 75e-2) THEN p ELSE h END AS top FROM b)
SELECT page_id, region_id, hyphenated, top, size FROM c JOIN w USING (page_id, region_id, hyphenated) WHERE fits AND size BETWEEN top - 3 AND top
QUALIFY row_number() OVER (PARTITION BY page_id, region_id ORDER BY balance, size DESC) = 1""", "det")
def _(c):
    return J.choose_size(c.spark.sql(SIZES.replace("{grid}", "LATERAL VIEW explode(sequence(6, 40)) s AS size"), det=c.det))


@query("break_points", f"""
WITH w AS (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '')
SELECT word, array_to_string({BREAKS.format(w="word")}, ',') AS points FROM w""")
def _(c):
    words = c.documents.select(F.explode(F.split("text", " ")).alias("word")).filter("word <> ''")
    return J.break_points(words).select("word", F.array_join(F.transform("points", lambda i: i.cast("string")), ",").alias("points"))


@query("text_duplicates", """
WITH t AS (SELECT doc_id // 100 AS page_id, doc_id AS region_id, text FROM documents),
u AS (SELECT page_id, text, min(region_id) AS first_id, count(*) AS copies FROM t GROUP BY ALL),
n AS (SELECT *, lead(text) OVER w AS nt, lead(first_id) OVER w AS nf FROM u WINDOW w AS (PARTITION BY page_id ORDER BY text)),
b AS (SELECT *, (SELECT count(*) FROM u v WHERE v.page_id = n.page_id AND v.text <> n.text AND starts_with(v.text, n.text)) AS longer FROM n)
SELECT page_id, region_id, first_id, copies, CASE WHEN longer > 0 THEN nf END AS begins FROM t JOIN b USING (page_id, text) WHERE copies > 1 OR longer > 0""")
def _(c):
    return J.text_duplicates(c.documents.select(F.expr("doc_id DIV 100").alias("page_id"), F.col("doc_id").alias("region_id"), "text"))


DIM_SQL = "(VALUES {rows}) {name}(k, v)"


@query("with_dims", f"""
SELECT doc_id, coalesce(t.v, 'EN') AS target, coalesce(f.v, 'default') AS formality FROM documents d
LEFT JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in X.TARGET_CODES.items())}) t(k, v) ON t.k = CASE d.lang WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE d.lang END
LEFT JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in X.FORMALITY.items())}) f(k, v) ON f.k = CASE doc_id % 3 WHEN 0 THEN 'Formal' WHEN 1 THEN 'Casual & Slang' ELSE 'Other' END""")
def _(c):
    d = c.documents.select(
        "doc_id", F.expr("CASE lang WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE lang END").alias("language"),
        F.expr("CASE doc_id % 3 WHEN 0 THEN 'Formal' WHEN 1 THEN 'Casual & Slang' ELSE 'Other' END").alias("style"))
    return J.with_dims(d).select("doc_id", "target", "formality")
