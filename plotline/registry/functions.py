"""Scalar functions over whole text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline import vocab
from plotline.functions import figures, headings, names, phrases, replies, similarity, typing, words
from plotline.functions.text import evaluated
from plotline.plans import continuity
from plotline.registry import query
from plotline.sources.tables import with_

# Phrases derived from the whole texts, in text both engines read alike: every stretch
# between marks of punctuation is one, dressed as a heading, cue, label or name.
WORD = "upper(regexp_extract(text, '[A-Za-z]+', 0))"
MARKS = "[.,;:!?\n]+"
PHRASES_SQL = f"""(SELECT doc_id, lang, source, generate_subscripts(ps, 1) - 1 AS pos, n_chars + generate_subscripts(ps, 1) - 1 AS n,
      trim(unnest(ps)) AS phrase FROM (SELECT *, regexp_split_to_array(text, '{MARKS}') AS ps FROM documents))"""
CAPS = "upper(replace(phrase, 'ß', 'ss'))"
HEADING = ("CASE lang WHEN 'en' THEN 'INT. ' WHEN 'fr' THEN 'ext/int. ' WHEN 'de' THEN 'I/E ' "
           "WHEN 'es' THEN 'EST.' ELSE 'Scene ' END || phrase || ' ' || source || "
           "CASE n % 4 WHEN 0 THEN ' - NIGHT' WHEN 1 THEN ' - KITCHEN' "
           "WHEN 2 THEN ' - Moments Later. #' || doc_id || 'A#' ELSE '' END")
CUE = (f"CASE n % 6 WHEN 0 THEN {CAPS} WHEN 1 THEN {CAPS} || ' (V.O.)' "
       f"WHEN 2 THEN {CAPS} || ' ^' WHEN 3 THEN '_' || {CAPS} || '._' "
       f"WHEN 4 THEN 'INT. ' || {CAPS} ELSE phrase END")
INLINE = (f"CASE n % 5 WHEN 0 THEN {CAPS} || '. ' || phrase "
          f"WHEN 1 THEN {CAPS} || ' [aside] ' || phrase "
          f"WHEN 2 THEN 'MRS. ' || {CAPS} || '. ' || phrase "
          f"WHEN 3 THEN 'ACT ' || {CAPS} || '. So it goes' ELSE phrase END")
STAGE = (f"CASE n % 7 WHEN 0 THEN 'ACT IV. ' || {CAPS} WHEN 1 THEN 'Act ' || n % 30 "
         f"WHEN 2 THEN 'SECOND ACT' WHEN 3 THEN 'SCENE XLIX. ' || phrase "
         f"WHEN 4 THEN 'Scene ' || {CAPS} WHEN 5 THEN 'Scene 3: ' || {CAPS} ELSE 'SCENE' END")
NAME = (f"CASE n % 4 WHEN 0 THEN 'The ' || phrase || ' (2)' "
        f"WHEN 1 THEN '  an ' || phrase || '.,' "
        f"WHEN 2 THEN phrase || '’s   “Gown” – ' || {CAPS} "
        f"ELSE phrase END")

HEADING_RE2 = r"(?i)^(INT\.?/EXT\.?|EXT\.?/INT\.?|I/E\.?|INT\.?|EXT\.?|EST\.?)([\s.].*)$"
CUE_RE2 = (r"^([\p{L}\p{Nl}\p{No}][\p{L}\p{N}_ .''\-#&]*?)((?:\s*\((?:[^)]*)\))*)\s*(\^)?\s*$")
TRANSITION_RE2 = headings.TRANSITION.replace("'", "''")
TIMES = ", ".join(f"'{w}'" for w in vocab.TIMES_OF_DAY)
STOP = ", ".join(f"'{w}'" for w in vocab.STOPWORDS)
CASEFOLD = "replace(lower(nfc_normalize({0})), 'ß', 'ss')"


def text_phrases(t):
    """Every phrase of every whole text, numbered in its document."""
    parts = t.texts.select("doc_id", "lang", "source", "n_chars", F.posexplode(F.split("text", MARKS)).alias("pos", "part"))
    return parts.select("doc_id", "lang", "source", F.col("pos").cast("long").alias("pos"),
                        (F.col("n_chars") + F.col("pos")).alias("n"), F.trim("part").alias("phrase"))


def derived(t, expression: str, name: str):
    """The phrases dressed as lines; the dress is worked out once for all that read it, filters too."""
    return evaluated(text_phrases(t), name, F.expr(expression.replace("\\", "\\\\"))).select("doc_id", "pos", name)


def _norm_sql(c: str) -> str:
    plain = CASEFOLD.format(c)
    for mark, stand_in in names.MARKS.items():
        plain = f"replace({plain}, '{mark}', '{stand_in * (2 if stand_in == chr(39) else 1)}')"
    spaced = rf"trim(regexp_replace({plain}, '\s+', ' ', 'g'))"
    bare = rf"regexp_replace(regexp_replace({spaced}, '\s*\([^)]*\)\s*$', ''), '^(a|an|the)\s+', '')"
    return f"trim(rtrim({bare}, '.,;:'))"


@query("F1_normalize", f"SELECT doc_id, pos, {_norm_sql(NAME)} AS name FROM {PHRASES_SQL}")
def f1(t):
    return derived(t, NAME, "raw").select("doc_id", "pos", names.normalize(F.col("raw")).alias("name"))


@query("F2_normalize_key", rf"""SELECT doc_id, pos, regexp_replace(trim({CASEFOLD.format(NAME)}),
    '\s+', '_', 'g') AS name FROM {PHRASES_SQL}""")
def f2(t):
    return derived(t, NAME, "raw").select("doc_id", "pos", names.normalize_key(F.col("raw")).alias("name"))


@query("F3_fold", """SELECT doc_id, md5(replace(lower(strip_accents(text)), 'ß', 'ss')) AS digest
    FROM documents""")
def f3(t):
    return t.texts.select("doc_id", F.md5(names.fold(F.col("text"))).alias("digest"))


@query("F4_split_heading", rf"""WITH h AS (SELECT doc_id, pos,
      trim(regexp_replace({HEADING}, '\s*#([\p{{L}}\p{{N}}_.\-]+)#\s*$', '')) AS x FROM {PHRASES_SQL}),
    p AS (SELECT doc_id, pos, x, regexp_matches(x, '{HEADING_RE2}') AS ok,
      rtrim(upper(regexp_extract(x, '{HEADING_RE2}', 1)), '.') AS prefix,
      trim(regexp_extract(x, '{HEADING_RE2}', 2)) AS rest FROM h),
    q AS (SELECT *, upper(rtrim(trim(string_split(rest, ' - ')[-1]), '.')) AS tail,
      contains(rest, ' - ') AS dashed FROM p)
    SELECT doc_id, pos,
      CASE WHEN NOT ok THEN NULL WHEN prefix IN ('I/E', 'EXT/INT') THEN 'INT/EXT' ELSE prefix END
        AS int_ext,
      nullif(CASE WHEN NOT ok THEN x WHEN dashed AND tail IN ({TIMES})
        THEN trim(regexp_extract(rest, '^(.*) - ', 1)) ELSE rest END, '') AS location,
      CASE WHEN ok AND dashed AND tail IN ({TIMES}) THEN tail END AS time_of_day FROM q""")
def f4(t):
    split = headings.split_heading(F.col("heading"))
    return derived(t, HEADING, "heading").select("doc_id", "pos", split.alias("s")).select("doc_id", "pos", "s.*")


CUE_SQL = rf"""c AS (SELECT doc_id, pos, replace(trim({CUE}), 'ẞ', 'SS') AS x FROM {PHRASES_SQL}),
    m AS (SELECT doc_id, pos, x, x = upper(x) AND x <> '' AND NOT regexp_matches(x, '{HEADING_RE2}')
        AND NOT regexp_matches(x, '{TRANSITION_RE2}') AND regexp_matches(x, '{CUE_RE2}') AS ok,
      trim(rtrim(trim(trim(regexp_extract(x, '{CUE_RE2}', 1)), '_'), '.'), '_') AS name,
      nullif(trim(regexp_extract(x, '{CUE_RE2}', 2)), '') AS extension,
      regexp_extract(x, '{CUE_RE2}', 3) <> '' AS dual FROM c)"""


@query("F5_parse_cue", rf"""WITH {CUE_SQL} SELECT doc_id, pos, name, extension, dual FROM m
    WHERE ok AND regexp_matches(name, '\p{{L}}')""")
def f5(t):
    return (evaluated(derived(t, CUE, "line"), "c", headings.cue(F.col("line")))
            .filter("c IS NOT NULL").select("doc_id", "pos", "c.*"))


INLINE_RE2 = (r"^([A-Z0-9][A-Z0-9 ''.\-]*?)(?:\.\s+([A-Za-z\x22''‘“].*)|\s*(\[.*))$")
_ABBR = ", ".join(f"'{w}'" for w in vocab.TITLE_ABBREVIATIONS)
INLINE_STEP = """regexp_extract({0}, '{1}', 1) AS {2}raw,
      trim(trim(rtrim(trim(trim(regexp_extract({0}, '{1}', 1)), '_'), '.'), '_')) AS {2}name,
      trim(regexp_extract({0}, '{1}', 2) || regexp_extract({0}, '{1}', 3)) AS {2}speech,
      regexp_matches({0}, '{1}') AS {2}ok"""


def _inline_ok(n: str) -> str:
    return (rf"(length({n}) BETWEEN 2 AND 35 AND len(list_filter(regexp_split_to_array({n}, '\s+'),"
            rf" lambda w: w <> '')) BETWEEN 1 AND 5 AND NOT list_has_any(regexp_split_to_array({n}, "
            rf"'\s+'), ['SCENE', 'ACT']) AND regexp_matches({n}, '\p{{L}}'))")


@query("F6_inline_cue", f"""WITH l AS (SELECT doc_id, pos, trim({INLINE}) AS x FROM {PHRASES_SQL}),
    a AS (SELECT *, {INLINE_STEP.format('x', INLINE_RE2, '')} FROM l),
    b AS (SELECT *, trim(ltrim(substr(x, length(raw) + 1), '. ')) AS y FROM a),
    d AS (SELECT *, {INLINE_STEP.format('y', INLINE_RE2, 'i')} FROM b),
    e AS (SELECT doc_id, pos, CASE WHEN upper(name) IN ({_ABBR}) THEN name || '. ' || iname
        ELSE name END AS name,
      CASE WHEN upper(name) IN ({_ABBR}) THEN ispeech ELSE speech END AS speech,
      ok AND (upper(name) NOT IN ({_ABBR}) OR (iok AND {_inline_ok('iname')})) AS good FROM d)
    SELECT doc_id, pos, name, md5(speech) AS speech FROM e WHERE good AND {_inline_ok('name')}""")
def f6(t):
    return (evaluated(derived(t, INLINE, "line"), "c", headings.inline_cue(F.col("line")))
            .filter("c IS NOT NULL").select("doc_id", "pos", "c.name", F.md5("c.speech").alias("speech")))


_ROMAN = ("(SELECT sum(CASE WHEN v < coalesce(after_max, 0) THEN -v ELSE v END) FROM (SELECT v, "
          "max(v) OVER (ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after_max "
          "FROM (SELECT i, CASE substr(upper(tok), i, 1) WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 "
          "WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 END AS v "
          "FROM range(1, length(tok) + 1) r(i))))")
ACT_RE2 = headings.ACT
SCENE_RE2 = headings.STAGE_SCENE
WORDVAL = "CASE lower(tok) " + " ".join(
    f"WHEN '{w}' THEN {n}" for w, n in vocab.WORD_ORDINALS.items()) + " END"


@query("F7_act_scene_ordinal", rf"""WITH l AS (SELECT doc_id, pos, trim({STAGE}) AS x FROM {PHRASES_SQL}),
    m AS (SELECT doc_id, pos, regexp_matches(x, '{ACT_RE2}') AS act,
      regexp_matches(x, '{SCENE_RE2}') AND x NOT LIKE 'scene%' AND
        (regexp_extract(x, '{SCENE_RE2}', 1) <> '' OR regexp_extract(x, '{SCENE_RE2}', 2) <> ''
         OR trim(regexp_extract(x, '{SCENE_RE2}', 3)) = '') AS scene,
      coalesce(nullif(regexp_extract(x, '{ACT_RE2}', 1), ''), regexp_extract(x, '{ACT_RE2}', 2)) AS a,
      regexp_extract(x, '{SCENE_RE2}', 1) AS s FROM l),
    k AS (SELECT doc_id, pos, act, scene, CASE WHEN act THEN a ELSE s END AS tok FROM m)
    SELECT doc_id, pos, CASE WHEN act THEN 'act' ELSE 'scene' END AS kind,
      CASE WHEN regexp_matches(tok, '^\d+$') THEN TRY_CAST(tok AS INTEGER)
        WHEN {WORDVAL} IS NOT NULL THEN {WORDVAL}
        WHEN regexp_matches(upper(tok), '^[IVXLCDM]+$') THEN nullif(CAST({_ROMAN} AS INTEGER), 0) END AS ordinal
    FROM k WHERE act OR scene""")
def f7(t):
    line = F.col("line")
    both = derived(t, STAGE, "line").select(
        "doc_id", "pos", headings.act_ordinal(line).alias("a"), headings.stage_scene(line).alias("s"))
    return both.filter("a.matched OR s.matched").select(
        "doc_id", "pos", F.when(F.col("a.matched"), "act").otherwise("scene").alias("kind"),
        F.when(F.col("a.matched"), F.col("a.ordinal")).otherwise(F.col("s.ordinal"))
        .alias("ordinal"))


@query("F8_location_of", rf"""WITH l AS (SELECT doc_id, pos, trim(ltrim(trim(trim(phrase || '. ' || source || ' room. ' || phrase), '[]_ '), '.-:— ')) AS x FROM {PHRASES_SQL}),
    p AS (SELECT doc_id, pos, x, string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM l),
    r AS (SELECT doc_id, pos, x, list_reduce(list_transform(parts, lambda q: trim(q)), lambda a, b: CASE WHEN
      len(regexp_split_to_array(a, '\s+')) >= 2 OR contains(a, chr(2)) THEN a
      WHEN a <> '' AND length(trim(a || ' ' || b)) > 120 THEN a || chr(2)
      ELSE trim(a || ' ' || b) END) AS place FROM p)
    SELECT doc_id, pos, trim(rtrim(trim(CASE WHEN place <> '' THEN replace(place, chr(2), '') ELSE left(x, 120) END), '.')) AS location FROM r""")
def f8(t):
    return derived(t, "'[SCENE: ' || phrase || '. ' || source || ' room. ' || phrase || ']'", "setting").select(
        "doc_id", "pos", headings.location_of(F.col("setting")).alias("location"))


@query("F9_page_figures", """WITH k AS (SELECT doc_id, length(text) AS c,
      greatest(1, CAST(round_even(length(text) / 800.0, 0) AS BIGINT)) AS pages,
      greatest(1, CAST(round_even(length(text) / 100.0, 0) AS BIGINT)) AS e FROM documents)
    SELECT doc_id, pages, c // 800 + 1 AS page_of,
      CASE WHEN pages * 9 >= 60 AND (pages * 9) % 60 > 0
        THEN (pages * 9) // 60 || 'h ' || (pages * 9) % 60 || 'm'
        WHEN pages * 9 >= 60 THEN (pages * 9) // 60 || 'h' ELSE (pages * 9) || 'm' END AS runtime,
      CASE WHEN e >= 8 AND e % 8 > 0 THEN e // 8 || ' ' || e % 8 || '/8'
        WHEN e >= 8 THEN CAST(e // 8 AS VARCHAR) ELSE e % 8 || '/8' END AS eighths FROM k""")
def f9(t):
    chars = F.char_length("text")
    return t.documents.select(
        "doc_id", figures.pages(chars).alias("pages"), figures.page_of(chars).alias("page_of"),
        figures.runtime(figures.pages(chars) * 9).alias("runtime"),
        figures.eighths(chars).alias("eighths"))


COST = "CASE event_type WHEN 'view' THEN value / 100 WHEN 'click' THEN value / 100000 " \
       "WHEN 'error' THEN value / 10000000 WHEN 'signup' THEN 0.0 END"


@query("F10_cost_display", f"""WITH k AS (SELECT event_id, {COST} AS c FROM events)
    SELECT event_id, CASE WHEN c >= 0.01 THEN printf('$%.2f', c) WHEN c >= 0.0001
      THEN printf('$%.4f', c) WHEN c > 0 THEN 'under $0.0001' WHEN c IS NOT NULL THEN '$0.00' END
      AS cost FROM k""")
def f10(t):
    return t.events.select("event_id", figures.cost_display(F.expr(COST)).alias("cost"))


@query("F11_when_label", "SELECT event_id, strftime(ts, '%d %b %H:%M') AS label FROM events")
def f11(t):
    return t.events.select("event_id", figures.when_label(F.col("ts")).alias("label"))


def line_pairs(t):
    """Each user turn with the turn that answers it."""
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("before"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"),
                               F.col("text").alias("after"))
    return a.join(b, ["conv_id", "turn"])


@query("F12_word_diff")
def f12(t):
    """Counts of words kept, cut and added between consecutive turns."""
    segments = line_pairs(t).filter("before <> after").withColumn(
        "d", similarity.word_diff("before", "after"))

    def count(op):
        parts = F.filter("d", lambda s: s["op"] == op)
        return F.aggregate(parts, F.lit(0), lambda acc, s: acc + F.size(F.split(s["text"], " ")))
    return segments.select("conv_id", "turn", *[count(op).alias(f"{op}_words")
                                                for op in ("equal", "del", "ins")])


@query("F13_similarity")
def f13(t):
    """Ratio of consecutive turns, only where the length bound allows the floor."""
    near = line_pairs(t).filter(similarity.ratio_bound(F.col("before"), F.col("after"))
                                >= vocab.WEAK_MATCH)
    return near.select("conv_id", "turn", F.round(similarity.ratio("before", "after"), 6)
                       .alias("ratio"))


@query("F14_content_hash", """SELECT conv_id, sha256('v1' || chr(0) || 'Conversation ' || conv_id ||
      chr(0) || string_agg(role || chr(0) || text, chr(0) ORDER BY turn)) AS input_hash
    FROM conversations GROUP BY conv_id""")
def f14(t):
    from plotline.plans.build import scene_hash
    units = t.conversations.select(
        F.col("conv_id").alias("scene_id"), F.col("turn").alias("sequence_index"),
        F.col("role").alias("unit_type"), "text")
    scenes = t.conversations.select(F.col("conv_id").alias("scene_id")).distinct().withColumn(
        "heading", F.concat(F.lit("Conversation "), "scene_id"))
    return scene_hash(scenes, units, "v1").select(F.col("scene_id").alias("conv_id"), "input_hash")


@query("F15_content_terms", f"""SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(
      regexp_split_to_array(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^0-9a-z]+'),
      lambda w: length(w) > 2 AND w NOT IN ({STOP})))), ' ') AS terms FROM benchmark""")
def f15(t):
    terms = F.array_sort(F.array_distinct(words.content_terms(F.col("text"))))
    return t.benchmark.select("item_id", F.array_join(terms, " ").alias("terms"))


# The shorter name: the first one, two or three words of the name, or its last ones.
@query("F16_name_extension", """WITH e AS (SELECT p_partkey, string_split(p_name, ' ') AS w, CASE WHEN p_size % 2 = 0 THEN string_split(p_name, ' ')[1:1 + p_partkey % 3]
      ELSE list_reverse(list_reverse(string_split(p_name, ' '))[1:1 + p_partkey % 3]) END AS v FROM part)
    SELECT p_partkey, len(v) < len(w) AND v = w[1:len(v)] AS extends, len(w) < len(v) AS reverse FROM e""")
def f16(t):
    full, k = F.split("p_name", " "), (F.lit(1) + F.col("p_partkey") % 3).cast("int")
    part = F.when(F.col("p_size") % 2 == 0, F.slice(full, F.lit(1), k)).otherwise(F.reverse(F.slice(F.reverse(full), F.lit(1), k)))
    return t.part.select("p_partkey", words.extends_name(part, full).alias("extends"),
                         words.extends_name(full, part).alias("reverse"))


@query("F17_canonical_endpoints", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_returnflag = 'R' AND l_partkey::VARCHAR > l_suppkey::VARCHAR THEN l_suppkey
      ELSE l_partkey END AS subject,
    CASE WHEN l_returnflag = 'R' AND l_partkey::VARCHAR > l_suppkey::VARCHAR THEN l_partkey
      ELSE l_suppkey END AS object FROM lineitem""")
def f17(t):
    predicate = F.when(F.col("l_returnflag") == "R", "interacts_with").otherwise("uses")
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             words.first_endpoint(predicate, a, b).alias("subject"),
                             words.second_endpoint(predicate, a, b).alias("object"))


@query("F18_snippets", r"""WITH k AS (SELECT doc_id, text,
      trim(regexp_replace(text, '\s+', ' ', 'g')) AS w FROM documents)
    SELECT doc_id, CASE WHEN length(text) <= 140 THEN text ELSE left(text, 137) || '…' END AS snippet,
      CASE WHEN w = '' THEN 'Untitled request' WHEN length(w) <= 48 THEN w
        ELSE coalesce(nullif(regexp_extract(left(w, 48), '^(.*) ', 1), ''), left(w, 48)) || '…' END
        AS title, left(text, 120) AS first_line FROM k""")
def f18(t):
    text = F.col("text")
    return t.documents.select("doc_id", figures.snippet(text).alias("snippet"),
                              figures.thread_title(text).alias("title"),
                              figures.first_line_card(text).alias("first_line"))


WRITTEN = (f"CASE n % 11 WHEN 0 THEN '@' || {CAPS} WHEN 1 THEN '!' || {CAPS} "
           f"WHEN 2 THEN '\"' || {CAPS} || '\"' WHEN 3 THEN '> ' || {CAPS} "
           f"WHEN 4 THEN '>> ' || {CAPS} WHEN 5 THEN '[[' || {CAPS} || ']]' "
           f"WHEN 6 THEN {CAPS} || ' CUT TO:' WHEN 7 THEN 'CLOSE ON ' || {CAPS} "
           f"WHEN 8 THEN '(' || {CAPS} || ')' WHEN 9 THEN {CAPS} ELSE phrase END")
ABOVE = "CASE doc_id % 4 WHEN 0 THEN 'character' WHEN 1 THEN 'dialogue' WHEN 2 THEN 'action' END"


@query("F19_line_type", rf"""WITH l AS (SELECT doc_id, pos, n % 11 AS k, {WRITTEN} AS x,
      {ABOVE} AS above, {CAPS} AS w, phrase AS f FROM {PHRASES_SQL}),
    s AS (SELECT *, CASE WHEN k < 6 THEN w ELSE x END AS y FROM l),
    c AS (SELECT *, y = upper(y) AS caps, y <> '' AND y = upper(y)
        AND NOT regexp_matches(trim(y), '{HEADING_RE2}')
        AND NOT regexp_matches(trim(y), '{TRANSITION_RE2}') AND regexp_matches(trim(y), '{CUE_RE2}')
        AND regexp_matches(y, '\p{{L}}') AS cue FROM s)
    SELECT doc_id, pos, CASE k WHEN 0 THEN 'character' WHEN 1 THEN 'action' WHEN 2 THEN 'dialogue'
        WHEN 3 THEN 'transition' WHEN 4 THEN 'shot' WHEN 5 THEN 'note' ELSE
        CASE WHEN regexp_matches(trim(y), '{HEADING_RE2}') THEN NULL WHEN y LIKE '(%' AND above IN ('character', 'dialogue') THEN 'parenthetical'
          WHEN regexp_matches(y, '^[A-Z0-9 .''-]+TO:$') THEN 'transition'
          WHEN caps AND y LIKE 'CLOSE ON%' THEN 'shot'
          WHEN above IS DISTINCT FROM 'character' AND caps AND length(y) <= 40 AND cue THEN 'character'
          WHEN above = 'character' THEN 'dialogue' ELSE 'action' END END AS unit_type,
      y AS words FROM c""")
def f19(t):
    lines = text_phrases(t).select("doc_id", "pos", F.expr(WRITTEN.replace("\\", "\\\\")).alias("line"),
                               F.expr(ABOVE).alias("above"))
    kind = typing.typed(F.col("line"), F.col("above"))
    return lines.select("doc_id", "pos", kind.alias("k")).select("doc_id", "pos", "k.unit_type", "k.words")


@query("F20_json_reply", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'malformed' ELSE 'ok' END
      AS state, CASE WHEN event_type <> 'error' THEN CAST(props ->> '$.k' AS BIGINT) END AS k
    FROM events""")
def f20(t):
    reply = F.when(F.col("event_type") == "error", F.concat("props", F.lit("}"))).otherwise(
        F.col("props"))
    parsed = replies.json_object(reply)
    return t.events.select(
        "event_id", F.when(parsed.isNull(), "malformed").otherwise("ok").alias("state"),
        F.try_variant_get(parsed, "$.k", "bigint").alias("k"))


@query("F21_confidence", """SELECT event_id, CASE WHEN event_type IN ('view', 'click')
      AND value / 50 BETWEEN 0.349 AND 1 THEN value / 50 END AS confidence FROM events""")
def f21(t):
    raw = F.expr("""CASE event_type WHEN 'view' THEN to_json(named_struct('c', value / 50))
        WHEN 'click' THEN to_json(named_struct('c', value / 50))
        WHEN 'error' THEN '{"c": true}' WHEN 'signup' THEN '{"c": "0.9"}' ELSE '{}' END""")
    value = F.try_variant_get(F.parse_json(raw), "$.c", "variant")
    return t.events.select("event_id", words.confidence(value, vocab.MINIMUM_CONFIDENCE - 0.001)
                           .alias("confidence"))


@query("F22_messages", """WITH k AS (SELECT c_custkey, c_name, count(*) AS n,
      string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS s,
      count(DISTINCT o_orderstatus) AS d
      FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT c_custkey, c_name || ' is used in scene' || CASE WHEN d = 1 THEN '' ELSE 's' END || ' ' || s
        || ' but no longer introduced.' AS orphan,
      c_name || ' is renamed NEW on this line, but ' || n || ' other line'
        || CASE WHEN n = 1 THEN '' ELSE 's' END || ' in scene' || CASE WHEN d = 1 THEN '' ELSE 's' END
        || ' ' || s || ' still name' || CASE WHEN n = 1 THEN 's' ELSE '' END || ' ' || c_name || '.'
        AS rename FROM k""")
def f22(t):
    k = (t.orders.groupBy("o_custkey")
         .agg(F.count(F.lit(1)).alias("n"),
              F.array_sort(F.collect_set("o_orderstatus")).alias("s"))
         .join(t.customer, F.col("o_custkey") == F.col("c_custkey")))
    name = F.col("c_name")
    return k.select("c_custkey", phrases.orphan_message(name, F.col("s")).alias("orphan"),
                    phrases.rename_message(name, F.lit("NEW"), F.col("n"), F.col("s"))
                    .alias("rename"))


@query("F22_preview_summary", """WITH k AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS r, count(*) FILTER (o_orderstatus = 'O') AS a,
      coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderstatus = 'P'), []) AS c,
      coalesce(list(o_orderpriority ORDER BY o_orderkey) FILTER (o_totalprice > 250000), []) AS m FROM orders GROUP BY 1)
    SELECT o_custkey, array_to_string(list_concat(CASE WHEN len(c) + r + a = 0 THEN ['No graph change.'] ELSE list_filter([
      CASE WHEN len(c) > 0 THEN 'Changes ' || len(c) || ' requirement(s): ' || array_to_string(list_transform(c[1:3],
        lambda x: x || ' becomes ' || (x + 1)), ', ') || '.' END, CASE WHEN r > 0 THEN 'Removes ' || r || ' assertion(s).' END,
      CASE WHEN a > 0 THEN 'Adds ' || a || ' assertion(s).' END], lambda x: x IS NOT NULL) END, m[1:2]), ' ') AS summary FROM k""")
def f22_summary(t):
    """A customer's orders as one proposal: P swaps, F removals, O additions; dear ones carry a finding."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    listed = lambda when, value: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(key.alias("k"), value.alias("v"))))), lambda x: x["v"])
    swap = F.struct(key.cast("string").alias("before"), (key + 1).cast("string").alias("after"))
    k = t.orders.groupBy("o_custkey").agg(
        F.count_if(status == "F").alias("r"), F.count_if(status == "O").alias("a"), listed(status == "P", swap).alias("c"),
        listed(F.col("o_totalprice") > 250000, F.col("o_orderpriority")).alias("m"))
    return k.select("o_custkey", phrases.preview_summary(F.col("c"), F.col("r"), F.col("a"), F.col("m")).alias("summary"))


@query("F23_stale_findings", """SELECT doc_id AS finding_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 <> 0
      AND (lower(text) LIKE '%contradicts%' OR lower(text) LIKE '%the established%' OR lower(text) LIKE '%conflicts with%' OR doc_id % 3 = 1)""")
def f23_stale(t):
    """Documents as findings: some closed, some restated, some from an older wording."""
    id_ = F.col("doc_id")
    findings = t.documents.select(
        id_.alias("finding_id"), F.when(id_ % 5 == 0, "resolved").otherwise("open").alias("status"), F.col("text").alias("message"),
        F.when(id_ % 3 == 0, '{"restated_under": "v2"}').when(id_ % 3 == 1, '{"restated_under": "v1", "restated_from": "It conflicts with scene 2"}')
        .alias("payload"))
    return continuity.stale_findings(findings, "v2").select("finding_id")


@query("F23_argued_form", """SELECT lang, count(*) AS n, count(*) FILTER (
      lower(text) LIKE '%contradicts%' OR lower(text) LIKE '%the established%'
      OR lower(text) LIKE '%conflicts with%' OR lower(text) LIKE '%the th%') AS argued
    FROM documents GROUP BY lang""")
def f23(t):
    text = F.col("text")
    hit = words.reads_as_argued(text) | F.lower(text).contains("the th")
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"),
                                           F.count_if(hit).alias("argued"))


@query("F24_display_number", """WITH k AS (SELECT c_nationkey, c_mktsegment,
      count(*) AS n FROM customer GROUP BY 1, 2),
    u AS (SELECT c_nationkey, list(DISTINCT CASE WHEN n % 2 = 0 THEN n || 'A' ELSE n || '' END) AS used
      FROM k GROUP BY 1)
    SELECT k.c_nationkey, k.c_mktsegment,
      [c FOR c IN list_transform(range(65, 91), lambda i: k.n || chr(CAST(i AS INTEGER)))
       IF NOT list_contains(used, c)][1] AS after_number,
      [c FOR c IN list_transform(range(1, 27), lambda i: repeat('A', CAST(i AS BIGINT)) || k.n)
       IF NOT list_contains(used, c)][1] AS before_first
    FROM k JOIN u USING (c_nationkey)""")
def f24(t):
    k = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.col("n") % 2 == 0, F.concat("n", F.lit("A"))).otherwise(F.col("n").cast("string"))
    used = k.groupBy("c_nationkey").agg(F.collect_set(own).alias("used"))
    n = F.col("n").cast("string")
    return k.join(used, "c_nationkey").select(
        "c_nationkey", "c_mktsegment",
        figures.inserted_number(n, n, F.col("used")).alias("after_number"),
        figures.inserted_number(F.lit(None).cast("string"), n, F.col("used")).alias("before_first"))


@query("F25_edge_phrase", with_("facts", then="""SELECT assertion_id, 'S' || scene_id || ' '
      || CASE WHEN predicate = 'uses' THEN 'appears_in' ELSE predicate END || ' E' || object_entity_id
      || CASE WHEN predicate = 'uses' THEN CASE WHEN active THEN ' (on stage)'
           ELSE ' (named but not present)' END ELSE '' END AS phrase FROM facts"""))
def f25(t):
    predicate = F.when(F.col("predicate") == "uses", "appears_in").otherwise(F.col("predicate"))
    manner = F.when(F.col("active"), "on_stage").otherwise("referenced")
    return t.facts.select("assertion_id", phrases.edge_phrase(
        F.concat(F.lit("S"), "scene_id"), predicate,
        F.concat(F.lit("E"), "object_entity_id"), manner).alias("phrase"))


@query("F25_answer_line", with_("scenes", "facts", "assertions", then="""SELECT script_id, any_value(c_name) || ': ' || max(k.n) || ' scene(s), '
      || count(DISTINCT object_entity_id) || ' entities, ' || count(*) || ' accepted assertions. ' || count(*) FILTER (predicate = 'uses')
      || ' accepted assertion(s) match, across scene(s) ' || coalesce(string_agg(DISTINCT z.sequence_index::VARCHAR, ', ' ORDER BY z.sequence_index::VARCHAR)
      FILTER (predicate = 'uses'), 'unknown') || '. Configure a model in Settings for a written answer.' AS line
    FROM assertions a JOIN scenes z USING (scene_id, script_id) JOIN (SELECT script_id, count(*) AS n FROM scenes GROUP BY 1) k USING (script_id)
    JOIN customer ON c_custkey = script_id WHERE active GROUP BY 1""").replace("\n, ", ", "))
def f25_answer(t):
    """Each script asked for what is used in it, scenes by label."""
    totals = t.scenes.groupBy("script_id").agg(F.count(F.lit(1)).alias("n"))
    labels = t.ordered_scenes.select("scene_id", F.col("sequence_index").cast("string").alias("label"))
    uses = F.col("predicate") == "uses"
    k = t.assertions.filter("active").join(labels, "scene_id").groupBy("script_id").agg(
        F.count_distinct("object_entity_id").alias("entities"), F.count(F.lit(1)).alias("assertions"), F.count_if(uses).alias("matching"),
        F.array_sort(F.collect_set(F.when(uses, F.col("label")))).alias("named"))
    k = k.join(totals, "script_id").join(t.customer.select(F.col("c_custkey").alias("script_id"), "c_name"), "script_id")
    return k.select("script_id", phrases.answer_line(F.col("c_name"), F.col("n"), F.col("entities"), F.col("assertions"),
                                                     F.col("matching"), F.col("named")).alias("line"))
