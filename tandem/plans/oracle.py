"""The registered queries as SQL over the same tables, for comparison."""

from __future__ import annotations

from ..sources import registry as rg
from .inputs import CLASSES, EVENTS, LANGS, TAGS, TURN_SPAN

# --- building blocks -----------------------------------------------------

FLAT = "replace(text, chr(10), ' ')"


def words_of(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def case_map(key: str, mapping: dict, default: str = "NULL") -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in mapping.items())
    return f"CASE {key} {arms} ELSE {default} END"


def case_name(key: str, mapping: dict, default: str = "NULL") -> str:
    return case_map(key, {v: k for k, v in mapping.items()}, default)


LANG_ID = case_map("lang", LANGS) + "::BIGINT"
SPLIT = "CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END"
DOCS = f"docs AS (SELECT doc_id AS sent_id, {SPLIT} AS split, text, lang AS label_raw, {LANG_ID} AS label, n_chars FROM documents)"
TURNS = f"turns AS (SELECT conv_id * {TURN_SPAN} + turn AS sent_id, * FROM conversations)"
PAIRS = TURNS + """, pairs AS (
  SELECT u.sent_id, u.conv_id, u.text, a.text AS text_pair, CAST(length(u.text) * 5 > length(a.text) AS BIGINT) AS label
  FROM turns u JOIN turns a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""
LEFT_PAIRS = PAIRS.replace("FROM turns u JOIN turns a", "FROM turns u LEFT JOIN turns a")


def tag_rule(shortest: int, every: int, odd: int | None) -> str:
    kind = "CASE WHEN length(word) % 3 = 0 THEN 'PER' ELSE 'LOC' END"
    if odd:
        kind = f"CASE WHEN word_pos % {odd} = 0 THEN 'ORG' ELSE {kind} END"
    return (
        f"CASE WHEN length(word) <= {shortest} THEN 'O' "
        f"ELSE CASE WHEN word_pos % {every} = 0 THEN 'B-' ELSE 'I-' END || {kind} END"
    )


GOLD, PRED = tag_rule(3, 4, None), tag_rule(4, 5, 11)


def word_rows(source: str, keep: str) -> str:
    return (
        f"SELECT {keep}, w.i - 1 AS word_pos, w.word FROM (SELECT {keep}, unnest(list_transform({words_of('text')}, "
        f"lambda x, i: {{'i': i, 'word': x}})) AS w FROM {source})"
    )


DOC_WORDS = f"{DOCS}, doc_words AS ({word_rows('docs', 'sent_id, split')})"
TAGGED = f"{DOC_WORDS}, tagged AS (SELECT *, {GOLD} AS gold, {PRED} AS pred FROM doc_words)"
TAG_ID = lambda c: "(" + case_map(c, TAGS) + ")::BIGINT"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def w(i: str, j: str, shift: int) -> str:
    return f"(((({i} + {shift}) * 31 + {j} * 17 + 7) % 23 - 11) / 50.0::DOUBLE)"


def b(i: str, shift: int) -> str:
    return f"(((({i} + {shift}) * 5) % 7 - 3) / 10.0::DOUBLE)"


def linear(v: str, out: int, width: int, shift: int, bias_shift: int) -> str:
    row = f"list_transform(range({width}), lambda j: {w('i', 'j', shift)})"
    return f"list_transform(range({out}), lambda i: list_dot_product({v}, {row}) + {b('i', bias_shift)})"


def attn(width: int) -> str:
    return f"list_transform(range({width}), lambda j: ((j * 7) % 11 - 5) / 10.0::DOUBLE)"


def enc(start: int, width: int) -> str:
    return f"embedding[{start + 1}:{start + width}]::DOUBLE[]"


def norm(v: str, width: int) -> str:
    mean = f"(list_sum({v}) / {width})"
    var = f"(list_sum(list_transform({v}, lambda q: (q - {mean}) * (q - {mean}))) / {width})"
    return f"list_transform({v}, lambda q: (q - {mean}) / sqrt({var} + 0.001))"


def items(source: str, vec: str, keep: str) -> str:
    """One row per vector item."""
    return (
        f"SELECT {keep}, x.j - 1 AS j, {r6('x.v')} AS value FROM (SELECT {keep}, "
        f"unnest(list_transform({vec}, lambda v, j: {{'j': j, 'v': v::DOUBLE}})) AS x FROM {source})"
    )


def dme(source: str, a_bias: float = 0.1, width: int = 32, keep: str = "sent_id, label") -> str:
    """CTEs `scored` (s1, s2 -> dme_1, dme_2) and `meta` (vec) over p1, p2."""
    return f"""scores AS (SELECT *, list_dot_product(p1, {attn(width)}) + {a_bias} AS s1,
                               list_dot_product(p2, {attn(width)}) + {a_bias} AS s2 FROM {source}),
    shares AS (SELECT *, exp(s1 - greatest(s1, s2)) / (exp(s1 - greatest(s1, s2)) + exp(s2 - greatest(s1, s2))) AS dme_1,
                      exp(s2 - greatest(s1, s2)) / (exp(s1 - greatest(s1, s2)) + exp(s2 - greatest(s1, s2))) AS dme_2 FROM scores),
    meta AS (SELECT {keep}, dme_1, dme_2, list_transform(range({width}), lambda k: dme_1 * p1[k + 1] + dme_2 * p2[k + 1]) AS vec FROM shares)"""


ENCODERS = f"""encoders AS (SELECT vec_id AS sent_id, label::BIGINT AS label, {enc(0, 64)} AS v, {enc(0, 32)} AS a, {enc(32, 32)} AS b2, {enc(0, 40)} AS l, {enc(40, 24)} AS r FROM embeddings)"""
PROJ_AB = f"{ENCODERS}, proj AS (SELECT sent_id, label, {linear('a', 32, 32, 0, 0)} AS p1, {linear('b2', 32, 32, 5, 1)} AS p2 FROM encoders)"
PROJ_LR = f"{ENCODERS}, proj AS (SELECT sent_id, label, {linear('l', 40, 40, 0, 0)} AS p1, {linear('r', 40, 24, 5, 1)} AS p2 FROM encoders)"
LOGITS = f"{ENCODERS}, logits AS (SELECT sent_id, label, {linear('v', 10, 64, 3, 3)} AS z FROM encoders)"
FIRST_MAX = "(list_position({z}, list_max({z})) - 1)::BIGINT"
LSE = "list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z)))))"
BATCHES = "batches AS (SELECT sent_id, (row_number() OVER (ORDER BY sent_id) - 1) // {n} AS batch_id FROM {source})"

TURN_WORDS = f"{TURNS}, turn_words AS ({word_rows('turns', 'sent_id')})"
STARTS = TURN_WORDS + f""", counted AS (SELECT *, ceil(length(word) / 4.0)::BIGINT AS n FROM turn_words),
  all_starts AS (SELECT *, 1 + coalesce(sum(n) OVER (PARTITION BY sent_id ORDER BY word_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM counted),
  starts AS (SELECT sent_id, word_pos, word, start::BIGINT AS start FROM all_starts)"""


def subwords(start: int, width: int, name: str = "subwords") -> str:
    return f"""{name} AS (SELECT s.sent_id, s.subword_pos, s.subword_pos >= s.total AS is_pad, e.embedding[{start + 1}:{start + width}]::DOUBLE[] AS vec
  FROM (SELECT sent_id, total, unnest(range(0, (ceil(total / 8.0) * 8)::BIGINT)) AS subword_pos
        FROM (SELECT t.sent_id, (coalesce(sum(n), 0) + 2)::BIGINT AS total FROM turns t LEFT JOIN counted c USING (sent_id) GROUP BY t.sent_id)) s
  JOIN embeddings e ON e.vec_id = (s.sent_id * 7 + s.subword_pos) % (SELECT count(*) FROM embeddings))"""


SUBWORDS = f"{STARTS}, {subwords(0, 64)}"
WORD_VECS = SUBWORDS + """, word_vecs AS (SELECT s.sent_id, s.word_pos, s.word, u.vec FROM starts s
  JOIN subwords u ON u.sent_id = s.sent_id AND u.subword_pos = s.start)"""
TAG_SCORES = f"{WORD_VECS}, tag_scores AS (SELECT sent_id, word_pos, word, {linear('vec', len(TAGS), 64, 3, 3)} AS z, {TAG_ID('(' + GOLD + ')')} AS tag_id FROM word_vecs)"


def fixed(vec: str, name: str = "items") -> str:
    return f"array_to_string(list_transform({vec}, lambda v: round(v::DOUBLE * 10000)::BIGINT), ',') AS {name}"



EVENT_PAIRS = f"""ep AS (SELECT event_type AS gold, CASE WHEN event_id % 3 = 0 THEN [{", ".join(f"'{e}'" for e in EVENTS)}][(event_id // 3) % 5 + 1]
  ELSE event_type END AS pred FROM events)"""
VALUE_PAIRS = "vp AS (SELECT value AS gold, value + (event_id * 37) % 101 AS pred FROM events)"
MATTHEWS = """m AS (SELECT (SELECT count(*) FROM ep)::DOUBLE AS s, (SELECT count(*) FROM ep WHERE gold = pred)::DOUBLE AS c,
  (SELECT sum(t.n::DOUBLE * coalesce(p.n, 0)) FROM (SELECT gold, count(*) n FROM ep GROUP BY 1) t LEFT JOIN (SELECT pred, count(*) n FROM ep GROUP BY 1) p ON t.gold = p.pred) AS tp,
  (SELECT sum(n::DOUBLE * n) FROM (SELECT count(*) n FROM ep GROUP BY gold)) AS tt,
  (SELECT sum(n::DOUBLE * n) FROM (SELECT count(*) n FROM ep GROUP BY pred)) AS pp)"""
MATTHEWS_VALUE = "CASE WHEN (s*s - pp) * (s*s - tt) = 0 THEN 0 ELSE (c*s - tp) / sqrt((s*s - pp) * (s*s - tt)) END"
RANKS = """ranks AS (SELECT rank() OVER (ORDER BY gold) + (count(*) OVER (PARTITION BY gold) - 1) / 2.0 AS x,
                        rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS y FROM vp)"""


def spans(side: str) -> str:
    """Gaps and islands over word rows: a flag where a span starts, a running count, one group per span."""
    return f"""{side}_k AS (SELECT sent_id, word_pos, {side} AS tag, CASE WHEN {side} = 'O' THEN NULL ELSE substr({side}, 3) END AS kind,
      lag(CASE WHEN {side} = 'O' THEN NULL ELSE substr({side}, 3) END) OVER (PARTITION BY sent_id ORDER BY word_pos) AS before FROM tagged),
    {side}_g AS (SELECT *, sum(CASE WHEN kind IS NOT NULL AND (starts_with(tag, 'B-') OR before IS NULL OR before <> kind) THEN 1 ELSE 0 END)
      OVER (PARTITION BY sent_id ORDER BY word_pos) AS island FROM {side}_k),
    {side}_spans AS (SELECT sent_id, kind AS type, min(word_pos) AS first_word, max(word_pos) AS last_word
      FROM {side}_g WHERE kind IS NOT NULL GROUP BY sent_id, island, kind)"""


SPANS = f"{TAGGED}, {spans('gold')}, {spans('pred')}"
ENTITY_F1 = """2.0 * (SELECT count(*) FROM gold_spans JOIN pred_spans USING (sent_id, type, first_word, last_word))
  / ((SELECT count(*) FROM gold_spans) + (SELECT count(*) FROM pred_spans))"""


def dev_rows(n: int) -> str:
    return f"""{DOCS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label_raw ORDER BY sent_id) AS rn FROM docs),
    dev AS (SELECT sent_id, label_raw, text FROM ranked WHERE rn <= {n})"""


def _registry_rows() -> str:
    rows = []
    for key, c in rg.CORPORA.items():
        pair = -1 if c.pair is None else c.pair
        fixed_part = f"'{key}', '{c.task}', {c.label}, {c.text}, {pair}, {str(c.header).lower()}, '{c.main_metric}'"
        for label, i in (c.label_map or {}).items():
            rows.append(f"({fixed_part}, '{label}', {i}, {len(c.label_map)})")
        if not c.label_map:
            # Regression: no classes, so no document falls in one.
            rows.append(f"({fixed_part}, NULL, NULL, NULL)")
    return ", ".join(rows)


PLAN = f"""{DOCS}, plan AS (SELECT n, u AS updates_per_epoch, u * 10 AS training_steps, ceil(u * 10 * 0.1::DOUBLE)::BIGINT AS warmup_steps
  FROM (SELECT count(*) AS n, ceil(count(*) / 16.0)::BIGINT AS u FROM docs WHERE split = 'train'))"""
BATCH_LOSS = f"""{LOGITS}, {BATCHES.format(n=16, source='logits')}, losses AS (
  SELECT batch_id, avg({LSE} - z[label + 1]) AS loss FROM logits JOIN batches USING (sent_id) GROUP BY batch_id)"""
QCLASS = "['" + "','".join(rg.QUESTION_CLASSES) + "'][doc_id % 6 + 1]"
QNAME = case_map(QCLASS, rg.QUESTION_CLASSES)

# --- one statement per query ---------------------------------------------

PREDICTIONS = f"""WITH {PROJ_AB}, {dme('proj')}, z AS (SELECT *, {linear('vec', 10, 32, 3, 3)} AS z FROM meta),
    p AS (SELECT *, {FIRST_MAX.format(z='z')} AS prediction FROM z)
    SELECT sent_id, text, {r6('dme_1')} AS dme_1, {r6('dme_2')} AS dme_2, prediction, {case_name('prediction', CLASSES)} AS prediction_name
    FROM p JOIN documents ON doc_id = sent_id"""

SQL: dict[str, str] = {
    # sources and sinks
    "src_labeled_tsv": f"SELECT lang AS label_raw, {LANG_ID} AS label, trim({FLAT}) AS text, 'single-sentence' AS sentence_type FROM documents",
    "src_tagged_blocks": f"""WITH {TAGGED} SELECT string_agg(word, ' ' ORDER BY word_pos) AS text, count(*) AS n_words,
        string_agg({TAG_ID('gold')}::VARCHAR, ',' ORDER BY word_pos) AS tags FROM tagged GROUP BY sent_id""",
    "src_corpus_splits": f"SELECT {SPLIT} AS split, {LANG_ID} AS label, trim({FLAT}) AS text FROM documents",
    "src_quoted_csv": "SELECT doc_id AS sent_id, '\"' || lang || '\", ' || text AS text FROM documents",
    "src_latin1_lines": f"SELECT {QNAME} AS label_raw, {FLAT} AS text FROM documents",
    "src_gzip_lines": f"SELECT 'documents' AS label_raw, {FLAT} AS text FROM documents UNION ALL SELECT 'benchmark', {FLAT} FROM benchmark",
    "sink_roundtrip": f"""WITH {PAIRS} SELECT CASE conv_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split,
        label, {FLAT} AS text, trim(replace(text_pair, chr(10), ' ')) AS text_pair FROM pairs""",
    "corpus_registry": f"""WITH reg(corpus, task, label_column, text_column, pair_column, header, main_metric, label, id, k) AS (VALUES {_registry_rows()})
        SELECT corpus, task, label_column::BIGINT AS label_column, text_column::BIGINT AS text_column, pair_column::BIGINT AS pair_column,
        header, main_metric, label, id::BIGINT AS id, count(doc_id) AS n FROM reg LEFT JOIN documents ON doc_id % k = id GROUP BY ALL""",
    "sink_ordered_rows": f"""WITH {DOCS} SELECT split, row_number() OVER (PARTITION BY split ORDER BY md5('13:2:' || sent_id), sent_id) - 1 AS idx, sent_id,
        regexp_replace(text, '[\\r\\n]', ' ', 'g') AS text FROM docs""",
    "sink_model_store": PREDICTIONS,
    "src_dev_variant": f"""WITH {PAIRS}, named AS (SELECT m.matched, CASE conv_id % 3 WHEN 0 THEN 'train' ELSE 'dev' END AS split,
        (conv_id % 3)::BIGINT AS label, {FLAT} AS text, replace(text_pair, chr(10), ' ') AS text_pair, conv_id % 3 AS part
        FROM pairs, (VALUES (true), (false)) m(matched))
        SELECT matched, split, label, text, text_pair FROM named WHERE part = 0 OR (matched AND part = 1) OR (NOT matched AND part = 2)""",
    # projections and labels
    "prj_pair_columns": f"WITH {PAIRS} SELECT sent_id, {FLAT} AS text, replace(text_pair, chr(10), ' ') AS text_pair, label FROM pairs",
    "prj_sentence_type": f"""WITH {LEFT_PAIRS} SELECT sent_id, CASE WHEN text_pair IS NULL THEN 'single-sentence' ELSE 'sentence-pair' END AS by_number,
        CASE WHEN text_pair IS NULL THEN 'single-sentence' ELSE 'sentence-pair' END AS sentence_type FROM pairs""",
    "flt_nonempty": "SELECT * FROM (SELECT doc_id AS sent_id, unnest(string_split(text, chr(10))) AS text FROM documents) WHERE text <> ''",
    "lbl_encode": f"""SELECT doc_id AS sent_id, CASE doc_id % 7 WHEN 0 THEN lang WHEN 1 THEN (doc_id % 4)::VARCHAR WHEN 2 THEN '1.0' WHEN 3 THEN 'nan'
        WHEN 4 THEN 'unknown' WHEN 5 THEN '1_' || (doc_id % 4) ELSE '1d' END AS label_raw,
        CASE doc_id % 7 WHEN 0 THEN {LANG_ID} WHEN 1 THEN doc_id % 4 WHEN 5 THEN 10 + doc_id % 4 ELSE -1 END AS label FROM documents""",
    "lbl_decode": f"SELECT doc_id AS sent_id, n_chars % 5 AS label, {case_name('n_chars % 5', LANGS, chr(39) + 'none' + chr(39))} AS name FROM documents",
    "lbl_coarse_split": "SELECT doc_id AS sent_id, 'language_' || lang AS label_raw, text FROM documents",
    "lbl_inline_tag": "SELECT doc_id AS sent_id, lang AS label_raw, regexp_replace(text, '<.*?>', '', 'g') AS text FROM documents",
    "lbl_first_annotation": f"WITH {TAGGED} SELECT gold AS tag, count(*) AS n FROM tagged GROUP BY gold",
    "prj_clean_tabs": "SELECT doc_id AS sent_id, text FROM documents WHERE doc_id % 5 <> 0",
    "lbl_target_choice": """SELECT event_id, value AS target, 'valence' AS label_type FROM events
        UNION ALL SELECT event_id, (event_id % 100)::DOUBLE, 'arousal' FROM events""",
    "prj_sep_join": f"WITH {LEFT_PAIRS} SELECT sent_id, CASE WHEN text_pair IS NULL THEN text ELSE text || ' SEP ' || text_pair END AS text FROM pairs",
    "prj_zip_pairs": f"""WITH {PAIRS}, cut AS (SELECT sent_id, string_split(text, chr(10)) AS x, string_split(text_pair, chr(10)) AS y FROM pairs),
        grid AS (SELECT *, unnest(range(0, greatest(len(x), len(y)))) AS pos FROM cut)
        SELECT sent_id, pos, x[pos + 1] AS text, y[pos + 1] AS text_pair FROM grid""",
    "set_label_union": "SELECT 'document' AS label_raw, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark",
    # splits and order
    "split_first_n_per_label": f"WITH {dev_rows(30)} SELECT sent_id, label_raw FROM dev",
    "split_train_antijoin": f"""WITH {dev_rows(30)} SELECT sent_id, 'dev' AS split FROM dev UNION ALL
        SELECT sent_id, 'train' FROM docs d WHERE NOT EXISTS (SELECT 1 FROM dev v WHERE v.label_raw = d.label_raw AND v.text = d.text)""",
    "split_head_n": """SELECT event_id, event_type, CASE WHEN row_number() OVER (ORDER BY event_id) <= 800 THEN 'dev' ELSE 'train' END AS split FROM events""",
    "split_by_column": """SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'train' WHEN 'view' THEN 'dev' ELSE 'test' END AS split
        FROM events WHERE event_type IN ('click', 'view', 'error')""",
    "shuffle_epoch_order": """SELECT 1 AS epoch, doc_id AS sent_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents UNION ALL
        SELECT 2, doc_id, row_number() OVER (ORDER BY md5('13:2:' || doc_id), doc_id) - 1 FROM documents""",
    "slice_rows": """SELECT event_id, event_type, idx FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM events) WHERE idx >= 150 AND idx < 650""",
    "idx_rows": """SELECT doc_id AS sent_id, quality::BIGINT AS label, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents JOIN labels USING (doc_id)""",
    "idx_file_rows": "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS idx, row_number() OVER (ORDER BY event_id) - 1 AS line_no FROM events",
    # statistics
    "agg_label_dictionary": f"WITH {DOCS} SELECT label, count(*) AS n FROM docs WHERE split <> 'test' GROUP BY label",
    "agg_tag_dictionary": f"WITH {TAGGED} SELECT {TAG_ID('gold')} AS label, count(*) AS n FROM tagged WHERE split <> 'test' GROUP BY 1",
    "agg_num_classes": "SELECT count(DISTINCT quality) AS num_classes FROM documents JOIN labels USING (doc_id) WHERE doc_id % 10 <> 0",
    "agg_split_sizes": """SELECT train, dev, test, 'train ' || train || ' + dev ' || dev || ' + test ' || test AS line FROM (
        SELECT count(*) FILTER (doc_id % 10 > 1) AS train, count(*) FILTER (doc_id % 10 = 1) AS dev, count(*) FILTER (doc_id % 10 = 0) AS test FROM documents)""",
    "agg_corpus_statistics": f"""WITH {DOCS} SELECT 'documents' AS name, 'Sentence classification' AS task,
        count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'dev') AS dev, count(*) FILTER (split = 'test') AS test,
        'accuracy,f1_score' AS metrics,
        (SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM (SELECT label, count(*) n FROM docs WHERE split <> 'test' GROUP BY 1)) AS label_frequency,
        '{",".join(f"{k}={v}" for k, v in LANGS.items())}' AS label_map FROM docs""",
    # batches
    "batch_assign": """SELECT doc_id AS sent_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id,
        (row_number() OVER (ORDER BY doc_id) - 1) % 16 AS pos_in_batch FROM documents""",
    "batch_pad_tags": f"""WITH {TAGGED}, per AS (SELECT sent_id, list({TAG_ID('gold')} ORDER BY word_pos) AS tags FROM tagged GROUP BY sent_id),
        {BATCHES.format(n=16, source='per')}, longest AS (SELECT batch_id, max(len(tags)) AS m FROM per JOIN batches USING (sent_id) GROUP BY batch_id)
        SELECT sent_id, batch_id, array_to_string(list_resize(tags, m, -1), ',') AS tags FROM per JOIN batches USING (sent_id) JOIN longest USING (batch_id)""",
    "batch_plan": f"WITH {PLAN} SELECT * FROM plan",
    "batch_pad_words": f"""WITH {WORD_VECS}, per AS (SELECT sent_id, count(*) AS n FROM word_vecs GROUP BY sent_id),
        {BATCHES.format(n=4, source='per')}, sized AS (SELECT *, max(n) OVER (PARTITION BY batch_id) AS m FROM per JOIN batches USING (sent_id)),
        grid AS (SELECT sent_id, batch_id, unnest(range(0, m)) AS word_pos FROM sized)
        SELECT sent_id, batch_id, word_pos, {fixed('coalesce(vec, list_transform(range(64), lambda j: 0.0::DOUBLE))')}
        FROM grid LEFT JOIN word_vecs USING (sent_id, word_pos)""",
    # words and embeddings
    "tok_words": f"WITH {DOC_WORDS} SELECT sent_id, word_pos, word FROM doc_words",
    "tok_subword_counts": f"""WITH {DOC_WORDS} SELECT word, max(ceil(length(word) / 4.0))::BIGINT AS n_subwords, count(*) AS n_occurrences
        FROM doc_words GROUP BY word""",
    "tok_vocabulary": f"""WITH {DOC_WORDS} SELECT word, row_number() OVER (ORDER BY md5(word), word) - 1 AS word_id,
        max(ceil(length(word) / 4.0))::BIGINT AS n_subwords, count(*) AS n_occurrences FROM doc_words GROUP BY word""",
    "tok_subword_table": f"""WITH {STARTS}, vocab AS (SELECT word, row_number() OVER (ORDER BY md5(word), word) - 1 AS word_id FROM turn_words GROUP BY word),
        totals AS (SELECT t.sent_id, (coalesce(sum(n), 0) + 2)::BIGINT AS total FROM turns t LEFT JOIN counted c USING (sent_id) GROUP BY t.sent_id),
        grid AS (SELECT sent_id, total, unnest(range(0, (ceil(total / 8.0) * 8)::BIGINT)) AS subword_pos FROM totals),
        inside AS (SELECT sent_id, word_pos, word, start, unnest(range(0, ceil(length(word) / 4.0)::BIGINT)) AS piece FROM starts)
        SELECT g.sent_id, g.subword_pos, i.word_pos, coalesce(i.piece = 0, false) AS is_first, g.subword_pos >= g.total AS is_pad,
        CASE WHEN i.piece = 0 THEN i.word END AS word, CASE WHEN i.piece = 0 THEN v.word_id END AS word_id
        FROM grid g LEFT JOIN inside i ON i.sent_id = g.sent_id AND i.start + i.piece = g.subword_pos LEFT JOIN vocab v ON v.word = i.word""",
    "tok_word_starts": f"""WITH {DOC_WORDS}, s AS (SELECT *, 1 + coalesce(sum(ceil(length(word) / 4.0)::BIGINT)
        OVER (PARTITION BY sent_id ORDER BY word_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM doc_words)
        SELECT sent_id, word_pos, word, start::BIGINT AS start FROM s""",
    "emb_hash_encode": f"""WITH {DOC_WORDS}, coded AS (SELECT sent_id, ('0x' || substr(md5(word), 1, 15))::BIGINT AS c FROM doc_words),
        sums AS (SELECT sent_id, (c >> 4) % 16 AS j, sum(CASE WHEN c % 2 = 0 THEN 1 ELSE -1 END) AS v FROM coded GROUP BY 1, 2),
        grid AS (SELECT sent_id, unnest(range(0, 16)) AS j FROM docs)
        SELECT sent_id, j, coalesce(v, 0)::DOUBLE AS value FROM grid LEFT JOIN sums USING (sent_id, j)""",
    "emb_batch_infer": f"""WITH per AS (SELECT doc_id AS sent_id, length(text) AS c, len({words_of('text')}) AS n, length(text) - length(replace(text, 'e', '')) AS e FROM documents),
        v AS (SELECT sent_id, [c / 1000.0::DOUBLE, n / 100.0::DOUBLE, c / greatest(1, n)::DOUBLE, e::DOUBLE]::FLOAT[] AS vec FROM per)
        {items('v', 'vec', 'sent_id')}""",
    "emb_pair_infer": f"""WITH {LEFT_PAIRS}, v AS (SELECT sent_id, [length(text) / 1000.0::DOUBLE, length(coalesce(text_pair, '')) / 1000.0::DOUBLE,
        (len({words_of('text')}) + len({words_of("coalesce(text_pair, '')")})) / 100.0::DOUBLE, CASE WHEN text_pair IS NULL THEN 0.0 ELSE 1.0 END]::FLOAT[] AS vec FROM pairs)
        {items('v', 'vec', 'sent_id')}""",
    "pool_cls": f"""WITH {SUBWORDS}, p AS (SELECT true AS cls_first, sent_id, arg_min(vec, subword_pos) AS vec FROM subwords WHERE NOT is_pad GROUP BY sent_id
        UNION ALL SELECT false, sent_id, arg_max(vec, subword_pos) FROM subwords WHERE NOT is_pad GROUP BY sent_id) {items('p', 'vec', 'cls_first, sent_id')}""",
    "pool_mean": f"""WITH {SUBWORDS}, e AS (SELECT sent_id, is_pad, x.j - 1 AS j, x.v AS v FROM (SELECT sent_id, is_pad,
        unnest(list_transform(vec, lambda v, j: {{'j': j, 'v': v}})) AS x FROM subwords))
        SELECT true AS include_pad, sent_id, j, {r6('avg(v)')} AS value FROM e GROUP BY sent_id, j
        UNION ALL SELECT false, sent_id, j, {r6('avg(v)')} FROM e WHERE NOT is_pad GROUP BY sent_id, j""",
    "pool_word_first": f"WITH {WORD_VECS} SELECT sent_id, word_pos, {fixed('vec')} FROM word_vecs",
    "pool_word_with_cls": f"""WITH {WORD_VECS} SELECT sent_id, word_pos + 1 AS word_pos, {fixed('vec')} FROM word_vecs
        UNION ALL SELECT sent_id, 0, {fixed('vec')} FROM subwords WHERE subword_pos = 0""",
    "emb_width_check": """SELECT 'all' AS encoder, min(len(embedding[1:64])) AS min_width, max(len(embedding[1:64])) AS max_width, true AS even FROM embeddings
        UNION ALL SELECT 'left', min(len(embedding[1:40])), max(len(embedding[1:40])), true FROM embeddings
        UNION ALL SELECT 'right', min(len(embedding[41:64])), max(len(embedding[41:64])), true FROM embeddings""",
    # combining
    "cmb_align": f"""WITH {ENCODERS} SELECT x.sent_id, x.label, {fixed('x.v', 'items_1')}, {fixed('y.l', 'items_2')}, {fixed('z.r', 'items_3')}
        FROM encoders x JOIN encoders y USING (sent_id) JOIN encoders z USING (sent_id)""",
    "cmb_project": f"""WITH {PROJ_LR}, two AS (SELECT 1 AS encoder, sent_id, p1 AS vec FROM proj UNION ALL SELECT 2, sent_id, p2 FROM proj)
        {items('two', 'vec', 'encoder, sent_id')}""",
    "cmb_layer_norm": f"""WITH {ENCODERS}, n AS (SELECT sent_id, {norm('v', 64)} AS u FROM encoders),
        s AS (SELECT sent_id, list_transform(range(64), lambda k: u[k + 1] * ((k * 7) % 11 - 5) / 10.0::DOUBLE + ((k * 5) % 7 - 3) / 10.0::DOUBLE) AS vec FROM n)
        {items('s', 'vec', 'sent_id')}""",
    "cmb_concat": f"WITH {ENCODERS} {items('encoders', 'list_concat(l, r)', 'sent_id')}",
    "cmb_mean": f"""WITH {PROJ_LR}, m AS (SELECT sent_id, list_transform(range(40), lambda k: (p1[k + 1] + p2[k + 1]) / 2) AS vec FROM proj)
        {items('m', 'vec', 'sent_id')}""",
    "cmb_dme_weights": f"""WITH {ENCODERS}, raw AS (SELECT sent_id, label, a AS p1, b2 AS p2 FROM encoders), {dme('raw')}
        SELECT sent_id, {r6('dme_1')} AS dme_1, {r6('dme_2')} AS dme_2 FROM meta""",
    "cmb_dme": f"""WITH {PROJ_LR}, normed AS (SELECT sent_id, label, {norm('p1', 40)} AS p1, {norm('p2', 40)} AS p2 FROM proj), {dme('normed', width=40)}
        {items('meta', 'vec', 'sent_id')}""",
    "cmb_dme_words": f"""WITH {STARTS}, {subwords(0, 32, 's1')}, {subwords(32, 32, 's2')},
        proj AS (SELECT s.sent_id, s.word_pos, {linear('s1.vec', 32, 32, 0, 0)} AS p1, {linear('s2.vec', 32, 32, 5, 1)} AS p2 FROM starts s
          JOIN s1 ON s1.sent_id = s.sent_id AND s1.subword_pos = s.start JOIN s2 ON s2.sent_id = s.sent_id AND s2.subword_pos = s.start),
        {dme('proj', keep='sent_id, word_pos')}
        SELECT sent_id, word_pos, {r6('dme_1')} AS dme_1, {r6('dme_2')} AS dme_2, {fixed('vec')} FROM meta""",
    "cmb_align_words": f"""WITH {STARTS}, {subwords(0, 40, 's1')},
        counted3 AS (SELECT *, ceil(length(word) / 3.0)::BIGINT AS n FROM turn_words),
        starts3 AS (SELECT *, (1 + coalesce(sum(n) OVER (PARTITION BY sent_id ORDER BY word_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM counted3),
        s2 AS (SELECT s.sent_id, s.word_pos, e.embedding[41:64]::DOUBLE[] AS vec FROM starts3 s
          JOIN embeddings e ON e.vec_id = (s.sent_id * 7 + s.start) % (SELECT count(*) FROM embeddings)),
        proj AS (SELECT s.sent_id, s.word_pos, {linear('s1.vec', 40, 40, 0, 0)} AS p1, {linear('s2.vec', 40, 24, 5, 1)} AS p2 FROM starts s
          JOIN s1 ON s1.sent_id = s.sent_id AND s1.subword_pos = s.start JOIN s2 ON s2.sent_id = s.sent_id AND s2.word_pos = s.word_pos),
        {dme('proj', width=40, keep='sent_id, word_pos')}
        SELECT sent_id, word_pos, {r6('dme_1')} AS dme_1, {r6('dme_2')} AS dme_2, {fixed('vec')} FROM meta""",
    "rpt_attention": f"""WITH {PROJ_AB}, {dme('proj')} SELECT label, {r6('avg(dme_1)')} AS dme_1, {r6('avg(dme_2)')} AS dme_2, count(*) AS n FROM meta GROUP BY label""",
    # heads
    "head_logits": f"WITH {LOGITS} {items('logits', 'z', 'sent_id')}",
    "head_softmax": f"""WITH {LOGITS}, p AS (SELECT sent_id, list_transform(z, lambda x: exp(x - list_max(z)) / list_sum(list_transform(z, lambda y: exp(y - list_max(z))))) AS q FROM logits)
        {items('p', 'q', 'sent_id')}""",
    "head_classify": f"WITH {LOGITS} SELECT sent_id, label, {FIRST_MAX.format(z='z')} AS pred FROM logits",
    "head_regress": f"WITH {LOGITS} SELECT sent_id, {r6('z[1]')} AS score FROM logits",
    "head_tag_words": f"WITH {TAG_SCORES} SELECT sent_id, word_pos, {FIRST_MAX.format(z='z')} AS pred FROM tag_scores",
    "head_classify_with_attention": f"""WITH {PROJ_AB}, {dme('proj')}, z AS (SELECT *, {linear('vec', 10, 32, 3, 3)} AS z FROM meta)
        SELECT sent_id, label AS gold, {FIRST_MAX.format(z='z')} AS pred, {r6('dme_1')} AS dme_1, {r6('dme_2')} AS dme_2 FROM z""",
    "rpt_predictions": PREDICTIONS,
    "rpt_word_tags": f"""WITH {TAG_SCORES}, p AS (SELECT *, {FIRST_MAX.format(z='z')} AS pred FROM tag_scores)
        SELECT sent_id, string_agg(word || '/' || {case_name('pred', TAGS)}, ' ' ORDER BY word_pos) AS report FROM p GROUP BY sent_id""",
    "loss_cross_entropy": f"WITH {BATCH_LOSS} SELECT batch_id, {r6('loss')} AS loss FROM losses",
    "loss_mse": f"""WITH {LOGITS}, {BATCHES.format(n=16, source='logits')}
        SELECT batch_id, {r6('avg((z[1] - label) * (z[1] - label))')} AS loss FROM logits JOIN batches USING (sent_id) GROUP BY batch_id""",
    "loss_tags": f"""WITH {TAG_SCORES}, {BATCHES.format(n=4, source='turns')},
        per AS (SELECT batch_id, sent_id, avg({LSE} - z[tag_id + 1]) AS loss FROM tag_scores JOIN batches USING (sent_id) GROUP BY batch_id, sent_id)
        SELECT batch_id, {r6('avg(loss)')} AS loss FROM per GROUP BY batch_id""",
    # metrics
    "met_confusion": f"WITH {EVENT_PAIRS} SELECT gold, pred, count(*) AS n FROM ep GROUP BY gold, pred",
    "met_accuracy": f"WITH {EVENT_PAIRS} SELECT {r6('avg((gold = pred)::INT)')} AS value FROM ep",
    "met_f1_micro": f"""WITH {EVENT_PAIRS}, k AS (SELECT count(*) FILTER (gold = pred)::DOUBLE AS tp, count(*) FILTER (gold <> pred)::DOUBLE AS f FROM ep)
        SELECT {r6('2 * tp / (2 * tp + f + f)')} AS value FROM k""",
    "met_matthews": f"WITH {EVENT_PAIRS}, {MATTHEWS} SELECT {r6(MATTHEWS_VALUE)} AS value FROM m",
    "met_pearson": f"WITH {VALUE_PAIRS} SELECT {r6('corr(gold, pred)')} AS value FROM vp",
    "met_spearman": f"WITH {VALUE_PAIRS}, {RANKS} SELECT {r6('corr(x, y)')} AS value FROM ranks",
    "met_unpad_tags": f"WITH {TAGGED} SELECT sent_id, word_pos, gold, pred FROM tagged",
    "met_tag_accuracy": f"WITH {TAGGED} SELECT {r6('avg((gold = pred)::INT)')} AS value FROM tagged",
    "met_entity_spans": f"""WITH {SPANS} SELECT sent_id, 'gold' AS side, type, first_word, last_word FROM gold_spans
        UNION ALL SELECT sent_id, 'pred', type, first_word, last_word FROM pred_spans""",
    "met_entity_f1": f"WITH {SPANS} SELECT {r6(ENTITY_F1)} AS value",
    "met_val_loss": f"WITH {BATCH_LOSS} SELECT {r6('avg(loss)')} AS value FROM losses",
    "eval_corpus": f"""WITH {EVENT_PAIRS}, {MATTHEWS}, {VALUE_PAIRS}, {RANKS}, {SPANS}
        SELECT 'classification' AS task, 0::BIGINT AS rank, 'matthews_corr' AS metric, {r6(MATTHEWS_VALUE)} AS value FROM m
        UNION ALL SELECT 'classification', 1, 'accuracy', {r6('avg((gold = pred)::INT)')} FROM ep
        UNION ALL SELECT 'classification', 2, 'f1_score', {r6('avg((gold = pred)::INT)')} FROM ep
        UNION ALL SELECT 'regression', 0, 'spearmanr', {r6('corr(x, y)')} FROM ranks
        UNION ALL SELECT 'regression', 1, 'pearsonr', {r6('corr(gold, pred)')} FROM vp
        UNION ALL SELECT 'labeling', 0, 'accuracy', {r6('avg((gold = pred)::INT)')} FROM tagged
        UNION ALL SELECT 'labeling', 1, 'f1_score', {r6(ENTITY_F1)}""",
    "sel_best_epoch": """SELECT epoch, score FROM (SELECT user_id % 20 AS epoch, floor(max(value) / 100)::DOUBLE AS score FROM events GROUP BY 1)
        ORDER BY score DESC, epoch LIMIT 1""",
    "rpt_run_summary": f"""WITH runs AS (SELECT event_type AS combo, user_id % 5 AS run, avg(value) AS score FROM events GROUP BY 1, 2)
        SELECT combo, count(*) AS runs, {r6('avg(score)')} AS mean, {r6('stddev_samp(score)')} AS deviation,
        {r6("avg(score) - (SELECT avg(score) FROM runs WHERE combo = 'click')")} AS gain FROM runs GROUP BY combo""",
    "rpt_progress_loss": f"""WITH {BATCH_LOSS}, sized AS (SELECT batch_id, loss, greatest(1, (SELECT count(*) FROM losses) // 10) AS step FROM losses),
        parts AS (SELECT batch_id // step AS part, avg(loss) AS loss FROM sized GROUP BY 1)
        SELECT part, {r6('loss')} AS loss FROM parts""",
    # training
    "fit_lr_schedule": f"""WITH {PLAN}, s AS (SELECT unnest(range(0, training_steps)) AS step, training_steps AS t, warmup_steps AS w FROM plan)
        SELECT step, {r6('20 * CASE WHEN step < w THEN step / greatest(1, w)::DOUBLE ELSE greatest(0, (t - step) / greatest(1, t - w)::DOUBLE) END')} AS lr_millionths FROM s""",
}
