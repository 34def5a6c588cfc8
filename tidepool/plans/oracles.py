"""DuckDB SQL for the registered queries, written apart from the Spark plans."""

from __future__ import annotations

from tidepool.functions.text import STOPWORDS

_SPACE = r"[ \t\n\r\f\x0B]+"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _clean(text: str) -> str:
    plain = rf"regexp_replace(lower(replace({text}, '[SEP]', '')), '[!-/:-@\[-`{{-~]', '', 'g')"
    keep = r"(regexp_matches(w, '^\p{L}+$') OR regexp_matches(w, '^\p{Nd}+$') OR (regexp_matches(w, '[0-9]') AND regexp_matches(w, '[a-zA-Z]')))"
    return f"list_filter(string_split_regex({plain}, '{_SPACE}'), lambda w: {keep} AND NOT list_contains({_STOP}, w))"


_PAGES = f"""pages AS (SELECT doc_id, '/docs/' || source || '/' || doc_id || '.txt' AS source,
  list_filter(string_split_regex(text, '{_SPACE}'), lambda x: x <> '') AS w FROM documents)"""


def _small(size: int = 100, overlap: int = 0) -> str:
    step = size - overlap
    n = f"CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= {size} THEN 1 ELSE CAST(ceil((len(w) - {overlap}) / {step}.0e0) AS BIGINT) END"
    return f"""{_PAGES}, counted AS (SELECT *, {n} AS n FROM pages),
numbered AS (SELECT source, w, n, unnest(range(n)) AS i FROM counted),
small AS (SELECT source, i AS small_chunk_idx, n AS n_chunks, array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') AS raw_text FROM numbered)"""


def _windows(steps: int = 3, size: int = 18) -> str:
    w = lambda j: f"greatest(0, CAST(floor(least({j}, n_chunks - {size} - 1) / {steps}.0e0) AS BIGINT))"
    old = f"CASE WHEN small_chunk_idx < {size} THEN 0 ELSE {steps} * (CAST(floor((small_chunk_idx - {size}) / {steps}.0e0) AS BIGINT) + 1) END"
    return f"win AS (SELECT *, {w(f'({old})')} AS win_lo, {w('small_chunk_idx')} AS win_hi FROM small)"


def _medium(scale: int = 3) -> str:
    return f"""med AS (SELECT source, CAST(floor(small_chunk_idx / {scale}.0e0) AS BIGINT) AS medium_chunk_idx, string_agg(raw_text, '' ORDER BY small_chunk_idx) AS raw_text,
  min(small_chunk_idx) AS small_lo, max(small_chunk_idx) AS small_hi, min(win_lo) AS win_lo, max(win_hi) AS win_hi, max(win_lo) AS lo_hi, min(win_hi) AS hi_lo FROM win GROUP BY ALL)"""


def _bm25(group: str, docs: str, asked: str, where: str, k: int) -> str:
    g = f"{group}, " if group else ""
    on = f"USING ({g}token)"
    cross = f"JOIN stats USING ({group})" if group else "CROSS JOIN stats"
    mean = f"JOIN means USING ({group})" if group else "CROSS JOIN means"
    by = f"GROUP BY {group}" if group else ""
    return f"""docs AS ({docs}), asked AS ({asked}),
stats AS (SELECT {g}count(*) AS n, avg(len(tokens)) AS avgdl FROM docs {by}),
tf AS (SELECT {g}doc_id, dl, token, count(*) AS tf FROM (SELECT {g}doc_id, len(tokens) AS dl, unnest(tokens) AS token FROM docs) GROUP BY ALL),
df AS (SELECT {g}token, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT {g}token, avgdl, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS idf FROM df {cross}),
means AS (SELECT {g}avg(idf) AS mean_idf FROM raw {by}),
idf AS (SELECT {g}token, avgdl, CASE WHEN idf < 0 THEN 0.25e0 * mean_idf ELSE idf END AS idf FROM raw {mean}),
q AS (SELECT {g}query_id, token, count(*) AS qtf FROM (SELECT {g}query_id, unnest(tokens) AS token FROM asked) GROUP BY ALL),
scored AS (SELECT {g}query_id, doc_id, round(sum(qtf * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score FROM q JOIN tf {on} JOIN idf {on} GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY {g}query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= {k})"""


_DOCS = f"SELECT doc_id, source, {_clean('text')} AS tokens FROM documents"
_ASKED = f"SELECT item_id AS query_id, {_clean('text')} AS tokens FROM benchmark"
_VEC = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"
_LISTS = """d AS (SELECT doc_id, lang AS query_id, md5(text) AS raw_md5, n_chars FROM documents),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS rank FROM d QUALIFY rank <= 20),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_md5, doc_id) AS rank FROM d QUALIFY rank <= 20)"""


def _fused(wa: float, wb: float) -> str:
    return f"""{_LISTS}, both_lists AS (SELECT *, 0 AS no, {wa}e0 / (rank + 60) AS part FROM a UNION ALL SELECT *, 1, {wb}e0 / (rank + 60) FROM b),
fused AS (SELECT query_id, raw_md5, round(sum(part), 9) AS score, min(rank) AS best_rank, arg_max(doc_id, no * 1000 + rank) AS doc_id FROM both_lists GROUP BY ALL)"""


_SPEAKER = "CASE WHEN role IN ('human', 'user') THEN 'Human: ' WHEN role IN ('ai', 'assistant') THEN 'Assistant: ' ELSE role || ': ' END"
_BASE = "regexp_extract(source, '[^/]*$')"

SQL: dict[str, str] = {
    "list_files": f"WITH {_PAGES} SELECT source, {_BASE} AS file_name, regexp_replace({_BASE}, '[.][^.]*$', '') AS title, regexp_extract(source, '[^.]*$') AS ext FROM pages",
    "file_names": f"WITH {_PAGES} SELECT DISTINCT {_BASE} AS file_name FROM pages",
    "token_lengths": f"WITH {_PAGES} SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens FROM pages",
    "chunk_small": f"WITH {_small()} SELECT source, small_chunk_idx, n_chunks, raw_text FROM small",
    "chunk_overlap": f"WITH {_small(100, 20)} SELECT source, small_chunk_idx, raw_text FROM small",
    "chunk_windows": f"WITH {_small()}, {_windows()} SELECT source, small_chunk_idx, win_lo, win_hi FROM win",
    "chunk_windows_fine": f"WITH {_small(10)}, {_windows(2, 7)} SELECT source, small_chunk_idx, win_lo, win_hi FROM win",
    "chunk_medium": f"WITH {_small()}, {_windows()}, {_medium()} SELECT source, medium_chunk_idx, small_lo, small_hi, win_lo, win_hi, raw_text FROM med",
    "chunk_medium_misaligned": f"WITH {_small(10)}, {_windows()}, {_medium(2)} SELECT source, medium_chunk_idx, CASE WHEN win_lo = lo_hi THEN win_lo END AS win_lo, CASE WHEN win_hi = hi_lo THEN win_hi END AS win_hi FROM med",
    "chunk_rollup": """WITH d AS (SELECT doc_id - doc_id % 10 AS g, * FROM documents),
firsts AS (SELECT g, list(lang ORDER BY seen) AS langs FROM (SELECT g, lang, min(doc_id) AS seen FROM d WHERE lang IS NOT NULL GROUP BY ALL) GROUP BY g),
sources AS (SELECT g, list(source ORDER BY seen) AS srcs FROM (SELECT g, source, min(doc_id) AS seen FROM d WHERE source IS NOT NULL GROUP BY ALL) GROUP BY g),
n AS (SELECT g, min(n_chars) AS a, max(n_chars) AS b, min(length(lang)) AS k FROM d GROUP BY g)
SELECT g AS first_id, CASE WHEN len(langs) = 1 THEN langs[1] END AS lang, CASE WHEN len(langs) > 1 THEN array_to_string(langs, ',') END AS lang_values,
  CASE WHEN len(srcs) = 1 THEN srcs[1] END AS source, CASE WHEN len(srcs) > 1 THEN array_to_string(srcs, ',') END AS source_values,
  CASE WHEN a = b THEN a END AS n_chars, CASE WHEN a < b THEN a END AS n_chars_lower_bound, CASE WHEN a < b THEN b END AS n_chars_upper_bound, k AS lang_size
FROM n LEFT JOIN firsts USING (g) LEFT JOIN sources USING (g)""",
    "ingested_files": f"""WITH {_small()}, {_windows()}, {_medium()}, every AS (SELECT 'small' AS kind, source, small_chunk_idx AS chunk_idx, raw_text FROM small UNION ALL SELECT 'medium', source, medium_chunk_idx, raw_text FROM med)
SELECT kind, CAST(regexp_extract(source, '([0-9]+)[.]txt$', 1) AS BIGINT) AS doc_id, chunk_idx, md5(raw_text) AS raw_md5 FROM every""",
    "incremental_ingest": f"""WITH {_small()}, {_windows()}, {_medium()} SELECT 'small' AS kind, source, small_chunk_idx AS chunk_idx, md5(raw_text) AS raw_md5 FROM small
UNION ALL SELECT 'medium', source, medium_chunk_idx, md5(raw_text) FROM med""",
    "pair_centre": f"""WITH {_small()}, {_windows()}, c AS (SELECT source, length(source) % 7 AS lo, length(source) % 7 + count(*) % 8 AS lo2, max(win_hi) AS m FROM win GROUP BY source),
p AS (SELECT source, lo, lo + 5 AS hi, lo2, lo2 + m % 5 + length(source) % 3 AS hi2 FROM c),
mid AS (SELECT *, (lo + hi + 1) // 2 AS a, (lo2 + hi2 + 1) // 2 AS b FROM p)
SELECT source, CAST(CASE WHEN lo2 > hi OR lo > hi2 THEN a WHEN lo <= lo2 AND hi2 <= hi THEN b ELSE round_even((a + b) / 2e0, 0) END AS BIGINT) AS centre FROM mid""",
    "enrich_md5": f"WITH {_small()}, t AS (SELECT *, regexp_replace({_BASE}, '[.][^.]*$', '') AS title FROM small) SELECT source, small_chunk_idx, title, md5(source) AS source_md5, md5(raw_text) AS raw_md5, md5(title || chr(10) || raw_text) AS embed_md5 FROM t",
    "clean_tokens": f"SELECT token, count(*) AS n FROM (SELECT unnest({_clean('text')}) AS token FROM documents) GROUP BY token",
    "filter_and_or": "SELECT doc_id, lang, n_chars FROM documents LEFT JOIN labels USING (doc_id) WHERE (lang = 'de' OR quality = 1) AND n_chars > 500 AND source <= 'src5'",
    "filter_ranges": "SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 200 AND 5000 AND doc_id < 10000000 AND lang = 'en'",
    "filter_ignore_empty": "WITH x AS (SELECT doc_id, lang = 'no such language' AS p, n_chars > 1000 AS r FROM documents), f AS (SELECT *, bool_or(p) OVER () AS any_p, bool_or(r) OVER () AS any_r FROM x) SELECT doc_id FROM f WHERE (p OR NOT any_p) AND (r OR NOT any_r) AND (any_p OR any_r)",
    "set_operations": "WITH a AS (SELECT lang, source FROM documents WHERE lang IN ('en', 'de')), b AS (SELECT lang, source FROM documents WHERE source < 'src3') SELECT lang, source, 'union' AS op FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT lang, source, 'intersect' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)",
    "window_stab": f"WITH {_small(10)}, {_windows()}, {_medium()} SELECT md5(source) AS source_md5, medium_chunk_idx, win_lo, win_hi FROM med WHERE 0 BETWEEN win_lo AND win_hi OR 2 BETWEEN win_lo AND win_hi",
    "bm25_top3": f"WITH {_bm25('', _DOCS, _ASKED, '', 3)} SELECT query_id, rank, doc_id, score FROM hits",
    "bm25_per_file": f"WITH {_bm25('source', _DOCS, f'SELECT source, query_id, tokens FROM ({_ASKED}) CROSS JOIN (SELECT DISTINCT source FROM documents)', '', 3)} SELECT source, query_id, rank, doc_id, score FROM hits",
    "vector_topk": f"WITH {_VEC}, s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.e, v.e), 6) AS score FROM v q CROSS JOIN v WHERE q.vec_id % 100 = 0) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s QUALIFY rank <= 5",
    "vector_topk_filtered": f"WITH {_VEC}, s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.e, v.e), 6) AS score FROM v q JOIN v USING (label) WHERE q.vec_id % 100 = 0) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s QUALIFY rank <= 5",
    "rrf_fuse": f"WITH {_fused(0.5, 0.5)} SELECT query_id, raw_md5, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, raw_md5) AS rank FROM fused",
    "rrf_dup_text": f"WITH {_fused(0.7, 0.3)} SELECT query_id, raw_md5, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, raw_md5) AS rank FROM fused",
    "select_last_per_source": f"WITH {_bm25('', _DOCS, _ASKED, '', 6)}, named AS (SELECT query_id, rank, doc_id, source FROM hits JOIN documents USING (doc_id)), one AS (SELECT query_id, source, arg_max(doc_id, rank) AS doc_id, min(rank) AS first_pos FROM named GROUP BY ALL) SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY first_pos) AS source_pos, doc_id FROM one",
    "dynamic_k": "SELECT lang, n_docs, n_queries, greatest(1, CAST(floor(40e0 / (n_docs * n_queries)) AS BIGINT)) AS k FROM (SELECT lang, count(DISTINCT source) AS n_docs, unnest([1, 2, 3])::BIGINT AS n_queries FROM documents GROUP BY lang)",
    "history_render": f"SELECT conv_id, string_agg(chr(10) || {_SPEAKER} || coalesce(text, ''), '' ORDER BY turn) AS history FROM conversations GROUP BY conv_id",
    "history_suffix": f"SELECT conv_id, turn, CAST(held AS BIGINT) AS held FROM (SELECT conv_id, turn, sum(len(list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> ''))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS held FROM conversations) WHERE held <= 120",
    "id_parse": "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN conv_id || ',2,' || turn WHEN 1 THEN '' ELSE '7' END AS ids FROM conversations",
    "snippet_render": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 5) SELECT lang, string_agg('Context ' || (rank - 1) || ':' || chr(10) || '{' || text || '}. {source: ' || source || '}', chr(10) || chr(10) || chr(10) ORDER BY rank) AS snippets FROM r GROUP BY lang",
    "context_assemble": """WITH d AS (SELECT doc_id, doc_id // 50 AS conv_id, CAST(substring(source, 4) AS INT) AS file_pos, source, ascii(lang) AS question_pos, doc_id % 50 AS m, md5(text) AS h, text FROM documents),
k AS (SELECT *, min(file_pos) OVER (PARTITION BY conv_id, h) AS first_pos FROM d),
f AS (SELECT conv_id, file_pos, source, coalesce(string_agg(CASE WHEN first_pos = file_pos THEN text END, chr(10) ORDER BY m, question_pos, doc_id), '') AS texts FROM k GROUP BY ALL)
SELECT conv_id, string_agg(chr(10) || 'Context about ' || source || ':' || chr(10) || '{' || texts || '}' || chr(10), '' ORDER BY file_pos) AS context FROM f GROUP BY conv_id""",
    "question_split": r"""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '[\r\n]', ' ', 'g') AS t FROM conversations)
SELECT conv_id, turn, CASE conv_id % 3
  WHEN 0 THEN array_to_string(list_transform(regexp_extract_all(chr(10) || '1. ' || t || chr(10) || '2. why ' || t, '\d+\.\s[^\n]*')[1:3], lambda x: regexp_replace(x, '^\d+\.\s', '')), '|')
  WHEN 1 THEN regexp_replace(trim(t, ' ' || chr(9) || chr(11) || chr(12)), '^Query: ?', '') || '|again'
  ELSE 'what is ' || trim(t, ' ' || chr(9) || chr(11) || chr(12)) END AS questions FROM c""",
    "speaker_strip": f"SELECT conv_id, turn, regexp_replace({_SPEAKER} || text, '^Human: ', '') AS line, role AS provider, CAST(conv_id AS VARCHAR) AS model, 'file.gguf' AS file FROM conversations",
    "prompt_refine": f"""WITH h AS (SELECT conv_id, string_agg(chr(10) || {_SPEAKER} || coalesce(text, ''), '' ORDER BY turn) AS history, arg_max(text, turn) AS question FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, 'Conversation so far:' || history || chr(10) || 'Rewrite the user''s last input as one to three questions that can be understood alone, numbered from 1.' || chr(10) || 'Input: ' || question || chr(10) || 'Questions:' AS p FROM h)
SELECT conv_id, md5('Files at hand: a.txt, b.txt' || chr(10) || p) AS prompt_md5, md5('[INST] Files at hand: a.txt' || chr(10) || p || ' [/INST]') AS wrapped_md5 FROM p""",
    "prompt_answer": """WITH s AS (SELECT conv_id, turn, text, 'Answer from the contexts alone, and say so if they do not hold the answer.' || chr(10) || text || chr(10) || role AS system FROM conversations)
SELECT conv_id, turn, md5('Below are numbered contexts. Name those that help to answer, most helpful first, as a list such as [0, 2]; [] if none does.' || chr(10) || text || chr(10) || chr(10) || 'Question: why?' || chr(10) || 'List:') AS select_md5,
  md5(system || chr(10) || 'Question: why?' || chr(10) || 'Answer:') AS plain_md5, md5(system) AS system_md5, 'why?' AS human FROM s""",
}

SQL["streamed_memory"] = SQL["history_suffix"]
SQL["value_index_and_or"] = SQL["filter_and_or"]
SQL["value_index_ignore_empty"] = SQL["filter_ignore_empty"]

_ENDINGS = {"s": "", "ses": "s", "ves": "f", "xes": "x", "zes": "z", "ches": "ch", "shes": "sh", "men": "man", "ies": "y"}
_NOUNS = (
    "children child feet foot geese goose mice mouse teeth tooth oxen ox lice louse indices index vertices vertex matrices matrix appendices appendix "
    "analyses analysis crises crisis theses thesis hypotheses hypothesis criteria criterion phenomena phenomenon lives life wives wife knives knife"
).split()
_LEMMAS = f"""WITH docs AS (SELECT doc_id, {_clean("text")} AS tokens FROM documents),
vocab AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM docs) GROUP BY token),
endings AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _ENDINGS.items())}) AS t(old, new)),
nouns AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in zip(_NOUNS[::2], _NOUNS[1::2], strict=True))}) AS t(token, lemma)),
tried AS (SELECT token, left(token, length(token) - length(old)) || new AS form FROM vocab JOIN endings ON suffix(token, old) WHERE regexp_full_match(token, '[a-z]+') AND NOT suffix(token, 'ss')),
forms AS (SELECT token, form FROM tried WHERE length(form) >= 3 AND form IN (SELECT token FROM vocab) UNION ALL SELECT token, token FROM vocab),
best AS (SELECT token, form FROM forms QUALIFY row_number() OVER (PARTITION BY token ORDER BY length(form), form) = 1),
lemma AS (SELECT token, coalesce(nouns.lemma, form) AS lemma FROM best LEFT JOIN nouns USING (token))"""
SQL["lemma_tokens"] = _LEMMAS + " SELECT lemma AS token, CAST(sum(n) AS BIGINT) AS n FROM lemma JOIN vocab USING (token) GROUP BY lemma"
SQL["lemma_documents"] = (
    _LEMMAS
    + """, spread AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM docs),
joined AS (SELECT doc_id, string_agg(lemma, ' ' ORDER BY pos) AS t FROM spread JOIN lemma USING (token) GROUP BY doc_id)
SELECT doc_id, CASE WHEN tokens IS NULL THEN NULL ELSE md5(coalesce(t, '')) END AS lemmas_md5 FROM docs LEFT JOIN joined USING (doc_id)"""
)
SQL["proximity_select"] = f"""WITH {_bm25('', _DOCS, _ASKED, '', 6)},
flat AS (SELECT query_id, rank, doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM hits JOIN docs USING (doc_id)),
held AS (SELECT DISTINCT f.* FROM flat f JOIN q USING (query_id, token)),
ends AS (SELECT a.query_id, a.rank, a.doc_id, a.pos, b.token, max(b.pos) AS last FROM held a JOIN held b ON a.query_id = b.query_id AND a.rank = b.rank AND b.pos <= a.pos GROUP BY ALL),
spans AS (SELECT query_id, rank, doc_id, pos, count(*) AS t, pos - min(last) + 1 AS w FROM ends GROUP BY query_id, rank, doc_id, pos),
best AS (SELECT query_id, rank, doc_id, t AS terms, min(w) AS width FROM spans GROUP BY query_id, rank, doc_id, t QUALIFY row_number() OVER (PARTITION BY query_id, rank ORDER BY t DESC) = 1)
SELECT query_id, doc_id, rank, terms, width, row_number() OVER (PARTITION BY query_id ORDER BY terms DESC, width, rank) AS place FROM best"""


def _raw(text: str) -> str:
    """Raw word tokens: the rules of the word tokenizer for RE2."""
    clitic = r"(?i)(\p{L})(n''t|''s|''re|''ve|''ll|''d|''m)([ \t\n\r\f\x0B]|$)"
    mark = r"([!?;,:()\[\]{}<>\"“”«»…@#$%&]|--+|\.\.+)"
    rules = [(r"[\x01\x02]", "' '")] + [(r"([0-9]),([0-9])", r"'\1' || chr(1) || '\2'")] * 2 + [(r"([0-9]):([0-9])", r"'\1' || chr(2) || '\2'")] * 2
    rules += [(mark, r"' \1 '"), (r"\x01", "','"), (r"\x02", "':'")] + [(clitic, r"'\1 \2 \3'")] * 2
    for pattern, by in rules:
        text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    return f"list_filter(string_split_regex({text}, '{_SPACE}'), lambda w: w <> '')"


_WORDS = rf"""WITH vocab AS (SELECT token, count(*) AS n FROM (SELECT unnest({_raw('text')}) AS token FROM documents) GROUP BY token),
ended AS (SELECT token, n, regexp_matches(token, '[^.]\.$') AS e FROM vocab),
named AS (SELECT token, n, e, lower(CASE WHEN e THEN left(token, length(token) - 1) ELSE token END) AS word FROM ended),
p AS (SELECT coalesce(sum(n) FILTER (e), 0) / sum(n) AS p FROM ended),
counted AS (SELECT word, CAST(coalesce(sum(n) FILTER (e), 0) AS BIGINT) AS k, CAST(coalesce(sum(n) FILTER (NOT e), 0) AS BIGINT) AS m, length(replace(word, '.', '')) AS l FROM named WHERE regexp_full_match(word, '\p{{L}}(\p{{L}}|\.\p{{L}})*') GROUP BY word),
scored AS (SELECT word, k AS n_with, m AS n_without, round(2 * (k * ln(0.99e0) + m * ln(1 - 0.99e0) - k * ln(p) - CASE WHEN m > 0 THEN m * ln(1 - p) ELSE 0 END) * exp(-l) * (length(word) - l + 1) * pow(l, -CAST(m AS DOUBLE)), 6) + 0e0 AS score FROM counted CROSS JOIN p WHERE k > 0)"""
SQL["learnt_abbreviations"] = _WORDS + " SELECT *, score >= 0.3e0 AS learnt FROM scored"
SQL["word_tokens"] = (
    _WORDS
    + """, cutting AS (SELECT token, n, e AND word NOT IN (SELECT word FROM scored WHERE score >= 0.3e0) AS c FROM named)
SELECT token, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN c THEN left(token, length(token) - 1) ELSE token END AS token, n FROM cutting UNION ALL SELECT '.', n FROM cutting WHERE c) GROUP BY token"""
)
