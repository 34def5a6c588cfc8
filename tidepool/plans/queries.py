"""The registered queries over the driver's tables.

documents are files, benchmark texts questions, embeddings a vector store whose
label stands for the file, conversations the chat history.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.checkpoint import cut, shared_folder
from tidepool.functions import prompts
from tidepool.functions import text as tx
from tidepool.functions.intervals import interval_centres
from tidepool.operators import chunking, filters, index, lemmas, proximity, search, value_index, vector_store, words
from tidepool.operators import tokens as bpe_tokens
from tidepool.plans import conversation, retrieval
from tidepool.plans.ingest import build_stores, ingest_folder, merge_pages
from tidepool.providers import get_embedding
from tidepool.sources.files import read_store, remove, write_texts
from tidepool.sources.stores import spread, stored
from tidepool.streaming import memory
from tidepool.streaming.ingest import arriving


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("/docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return _table(spark, sf, "documents").select(path.alias("source"), "text")


def _small(spark: SparkSession, sf: str, steps: int = 3, size: int = 18) -> DataFrame:
    return chunking.add_windows(chunking.split_by_words(_pages(spark, sf)), steps, size)


def _longs(df: DataFrame) -> DataFrame:
    """Integers as long, so both engines name one type."""
    return df.select(*[F.col(n).cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(n) for n, t in df.dtypes])


def list_files(spark, sf):
    """Names, titles and extensions of sources."""
    p = _pages(spark, sf)
    return p.select("source", tx.base_name(F.col("source")).alias("file_name"), tx.title(F.col("source")).alias("title"), tx.extension(F.col("source")).alias("ext"))


def file_names(spark, sf):
    """Distinct base names."""
    return _pages(spark, sf).select(tx.base_name(F.col("source")).alias("file_name")).distinct()


def token_lengths(spark, sf):
    """C1."""
    return _longs(_table(spark, sf, "documents").select("doc_id", F.size(tx.words(F.col("text"))).alias("n_tokens")))


def _vocabulary():
    import public_tokenizers

    return bpe_tokens.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def bpe_token_lengths(spark, sf):
    """C1 in byte-pair tokens: a batch's distinct words are merged where the texts lie."""
    docs = spread(_table(spark, sf, "documents").select("doc_id", "text"), f"{sf}/documents.parquet")
    return bpe_tokens.token_lengths(docs, ["doc_id"], _vocabulary())


def chunk_tokens(spark, sf):
    """Chunks of whole words, at most 100 byte-pair tokens each."""
    return _longs(bpe_tokens.split_by_tokens(spread(_pages(spark, sf), f"{sf}/documents.parquet"), _vocabulary(), 100).select("source", "small_chunk_idx", "n_chunks", "n_tokens", F.md5("raw_text").alias("raw_md5")))


def chunk_small(spark, sf):
    """C2, C3."""
    return _longs(chunking.split_by_words(_pages(spark, sf)).select("source", "small_chunk_idx", "n_chunks", "raw_text"))


def chunk_overlap(spark, sf):
    """C2 with overlap."""
    return _longs(chunking.split_by_words(_pages(spark, sf), 100, 20).select("source", "small_chunk_idx", "raw_text"))


def chunk_windows(spark, sf):
    """C4, W2."""
    return _longs(_small(spark, sf).select("source", "small_chunk_idx", "win_lo", "win_hi"))


def chunk_windows_fine(spark, sf):
    """C4 with other steps, over smaller chunks, so windows matter in more files."""
    small = chunking.add_windows(chunking.split_by_words(_pages(spark, sf), 10), 2, 7)
    return _longs(small.select("source", "small_chunk_idx", "win_lo", "win_hi"))


def chunk_medium(spark, sf):
    """C5, C6."""
    return _longs(chunking.merge_chunks(_small(spark, sf), 3).select("source", "medium_chunk_idx", "small_lo", "small_hi", "win_lo", "win_hi", "raw_text"))


def chunk_medium_misaligned(spark, sf):
    """C6 where merged bounds differ, T1."""
    small = chunking.add_windows(chunking.split_by_words(_pages(spark, sf), 10), 3, 18)
    return _longs(chunking.merge_chunks(small, 2, parity=True).select("source", "medium_chunk_idx", "win_lo", "win_hi"))


def chunk_rollup(spark, sf):
    """Any metadata of ten documents in a row rolled up: bounds of numbers, distinct values of the rest in order."""
    d = _table(spark, sf, "documents").select((F.col("doc_id") - F.col("doc_id") % 10).alias("first_id"), "doc_id", "lang", "source", "n_chars", F.length("lang").alias("lang_size"))
    out = chunking.roll_up(d, ["first_id"], ["lang", "source", "n_chars", "lang_size"], "doc_id")
    return _longs(out.select("first_id", "lang", F.array_join("lang_values", ",").alias("lang_values"), "source", F.array_join("source_values", ",").alias("source_values"), "n_chars", "n_chars_lower_bound", "n_chars_upper_bound", "lang_size"))


def ingested_files(spark, sf):
    """Every document as a text file of its own, loaded, chunked, stored and read back."""
    folder = f"{shared_folder(spark)}/ingested-{uuid.uuid4().hex}"
    docs = _table(spark, sf, "documents").select(F.coalesce("text", F.lit("")).alias("value"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"))
    write_texts(docs, f"{folder}/files")
    ingest_folder(spark, f"{folder}/files", f"{folder}/store", below=True)
    # Spark's own writer makes a folder of a name
    doc_id = F.regexp_extract("source", r"doc(\d+)(?:/[^/]*)?\.txt$", 1).cast("long").alias("doc_id")
    rows = None
    for name in ("small", "medium"):
        part = read_store(spark, f"{folder}/store/chunks_{name}").select(F.lit(name).alias("kind"), doc_id, F.col(f"{name}_chunk_idx").alias("chunk_idx"), "raw_md5")
        rows = part if rows is None else rows.unionByName(part)
    out = cut(_longs(rows))
    remove(spark, folder)
    return out


def incremental_ingest(spark, sf):
    """Stores brought up to date: every third document changes, every fifth comes, and others go, before all stand as they are."""
    store = f"{shared_folder(spark)}/merged-{uuid.uuid4().hex}"
    pages = _pages(spark, sf).withColumn("h", F.crc32("source"))
    other = pages.select("source", F.when(F.col("h") % 3 == 0, F.concat(F.lit("an older text. "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"), "h").where("h % 5 <> 0")
    gone = pages.where("h % 7 = 0").select(F.concat("source", F.lit(".old")).alias("source"), "text", "h")
    merge_pages(other.unionByName(gone).drop("h"), store)
    merge_pages(pages.drop("h"), store)
    rows = None
    for name in ("small", "medium"):
        part = read_store(spark, f"{store}/chunks_{name}").select(F.lit(name).alias("kind"), "source", F.col(f"{name}_chunk_idx").alias("chunk_idx"), "raw_md5")
        rows = part if rows is None else rows.unionByName(part)
    out = cut(_longs(rows))
    remove(spark, store)
    return out


def streamed_memory(spark, sf):
    """Conversations as a stream, held as state: what is left is the token-bounded suffix of each."""
    folder = f"{shared_folder(spark)}/memory-{uuid.uuid4().hex}"
    path = f"{sf}/conversations.parquet"
    stream = arriving(spark, path, spark.read.parquet(path).schema)
    memory.remember_into(stream, folder, 120)
    return memory.remembered(spark, folder).select("conv_id", "turn", "held")


def vector_approximate(spark, sf):
    """R2, J6, S9 from the approximate store: cells, codes and exact scores of what they find."""
    e, q = _vectors(spark, sf)
    store = stored(spark, f"{sf}/embeddings.parquet", "vectors", lambda folder: vector_store.build(e.select("vec_id", "embedding"), folder))
    return _longs(vector_store.approximate_top_k(store, q, 5).select("query_id", "rank", "vec_id", "score"))


def enrich_md5(spark, sf):
    """C7, C8."""
    return _longs(chunking.enrich(chunking.split_by_words(_pages(spark, sf))).select("source", "small_chunk_idx", "title", "source_md5", "raw_md5", F.md5("embed_text").alias("embed_md5")))


def clean_tokens(spark, sf):
    """X1-X8 as a frequency table."""
    return _table(spark, sf, "documents").select(F.explode(tx.clean_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def lemma_tokens(spark, sf):
    """clean_tokens as a frequency table of lemmas."""
    docs = spread(_table(spark, sf, "documents").select("text"), f"{sf}/documents.parquet")
    return lemmas.lemma_counts(lemmas.vocabulary(docs.select(tx.clean_tokens(F.col("text")).alias("tokens"))))


def lemma_documents(spark, sf):
    """The lemmas of each document in their order."""
    docs = spread(_table(spark, sf, "documents").select("doc_id", "text"), f"{sf}/documents.parquet")
    out = lemmas.lemmatize(docs.select("doc_id", tx.clean_tokens(F.col("text")).alias("tokens")), ["doc_id"])
    return out.select("doc_id", F.md5(F.array_join("tokens", " ")).alias("lemmas_md5"))


def _raw_words(spark, sf):
    docs = spread(_table(spark, sf, "documents").select("text"), f"{sf}/documents.parquet")
    return words.raw_vocabulary(docs)


def learnt_abbreviations(spark, sf):
    """All words before periods, scored as abbreviations by their counts in the corpus."""
    return words.scored(_raw_words(spark, sf)).select("*", (F.col("score") >= words.LEAST_SCORE).alias("learnt"))


def word_tokens(spark, sf):
    """Word tokens and how often they stand, periods set apart but for learnt abbreviations."""
    return words.token_counts(_raw_words(spark, sf))


def _labelled(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(_table(spark, sf, "labels"), "doc_id", "left")


def filter_and_or(spark, sf):
    """Nested conjunction and disjunction, missing keys."""
    tree = {"AND": [{"OR": [{"lang": ("==", "de")}, {"quality": ("==", 1)}]}, {"n_chars": (">", 500), "source": ("<=", "src5")}]}
    return _longs(filters.apply_filter(_labelled(spark, sf), tree).select("doc_id", "lang", "n_chars"))


def filter_ranges(spark, sf):
    """all comparisons, pushed to the scan."""
    tree = {"n_chars": (">=", 200), "doc_id": ("<", 10_000_000)}
    d = _table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    return filters.apply_filter(d, {"AND": [tree, {"n_chars": ("<=", 5000)}, {"lang": ("==", "en")}]}).select("doc_id", "n_chars")


def filter_ignore_empty(spark, sf):
    """a term that matches no row at all is left out of its leaf."""
    tree = {"lang": ("==", "no such language"), "n_chars": (">", 1000)}
    return filters.apply_filter(_table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), tree, "ignore").select("doc_id")


def _value_index(spark, sf):
    """The value index of all labelled documents, built once a session for the same files."""
    columns = ["lang", "source", "n_chars", "quality"]
    return stored(spark, f"{sf}/documents.parquet", "values", lambda folder: value_index.build(_labelled(spark, sf), folder, columns))


def value_index_and_or(spark, sf):
    """filter_and_or answered from bitmaps of values."""
    tree = {"AND": [{"OR": [{"lang": ("==", "de")}, {"quality": ("==", 1)}]}, {"n_chars": (">", 500), "source": ("<=", "src5")}]}
    return _longs(value_index.select(_value_index(spark, sf), tree).select("doc_id", "lang", "n_chars"))


def value_index_ignore_empty(spark, sf):
    """filter_ignore_empty answered from bitmaps of values."""
    tree = {"lang": ("==", "no such language"), "n_chars": (">", 1000)}
    return value_index.select(_value_index(spark, sf), tree, "ignore").select("doc_id")


def set_operations(spark, sf):
    """Union and intersection of results as rows."""
    d = _table(spark, sf, "documents").select("lang", "source")
    a, b = d.where("lang in ('en', 'de')"), d.where("source < 'src3'")
    return a.union(b).distinct().withColumn("op", F.lit("union")).union(a.intersect(b).withColumn("op", F.lit("intersect")))


def window_stab(spark, sf):
    """Medium chunks in the windows of centres 0 and 2 of each file."""
    small = chunking.add_windows(chunking.split_by_words(_pages(spark, sf), 10), 3, 18)
    medium = chunking.merge_chunks(small, 3).withColumn("source_md5", F.md5("source"))
    centres = medium.select("source_md5").distinct().select("source_md5", F.explode(F.array(F.lit(0), F.lit(2))).alias("centre"))
    return _longs(filters.in_windows(medium, centres).select("source_md5", "medium_chunk_idx", "win_lo", "win_hi"))


def _questions(spark, sf):
    return _table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), tx.clean_tokens(F.col("text")).alias("tokens"))


def _bm25_docs(spark, sf):
    docs = spread(_table(spark, sf, "documents").select("doc_id", "source", "text"), f"{sf}/documents.parquet")
    return docs.select("doc_id", "source", tx.clean_tokens(F.col("text")).alias("tokens"))


def _document_index(spark, sf, group=()):
    """The inverted index of all documents, built once a session for the same files."""
    return stored(spark, f"{sf}/documents.parquet", f"index-{'-'.join(group)}", lambda folder: index.build(_bm25_docs(spark, sf), folder, "doc_id", group))


def bm25_top3(spark, sf):
    """R1, K1, J5, A11 over the whole table, from the stored index."""
    return _longs(index.search(_document_index(spark, sf), _questions(spark, sf), 3).select("query_id", "rank", "doc_id", "score"))


def bm25_per_file(spark, sf):
    """R1, K3 with statistics of each source alone: every question is asked of every source."""
    return _longs(index.search(_document_index(spark, sf, ("source",)), _questions(spark, sf), 3).select("source", "query_id", "rank", "doc_id", "score"))


def _vectors(spark, sf):
    e = _table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    return e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def vector_topk(spark, sf):
    """R2, J6."""
    e, q = _vectors(spark, sf)
    return _longs(search.vector_top_k(e, q, 5, id_col="vec_id").select("query_id", "rank", "vec_id", "score"))


def vector_topk_filtered(spark, sf):
    """Limited to the question's file before the cut."""
    e, q = _vectors(spark, sf)
    return _longs(search.vector_top_k(e, q, 5, id_col="vec_id", file_col="label").select("query_id", "rank", "vec_id", "score"))


def mmr(spark, sf):
    """R2 with greedy diversity."""
    e, q = _vectors(spark, sf)
    return _longs(search.mmr(e, q, 5, 20, 0.5, id_col="vec_id").select("query_id", "rank", "vec_id", F.round("score", 6).alias("score")))


def _lists(spark, sf):
    """Two ranked lists of documents for each language: by length and by digest."""
    from pyspark.sql import Window

    d = _table(spark, sf, "documents").select("doc_id", F.col("lang").alias("query_id"), F.md5("text").alias("raw_md5"), "n_chars")
    top = lambda *o: d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*o))).where("rank <= 20")
    return top(F.desc("n_chars"), "doc_id"), top("raw_md5", "doc_id")


def rrf_fuse(spark, sf):
    """R4, A6, J2, K2."""
    a, b = _lists(spark, sf)
    return _longs(search.fuse([a, b], (0.5, 0.5), ["query_id"]).select("query_id", "raw_md5", "score", "rank"))


def rrf_dup_text(spark, sf):
    """Equal texts are one result with the last one's document."""
    a, b = _lists(spark, sf)
    return _longs(search.fuse([a, b], (0.7, 0.3), ["query_id"], payload=["doc_id"]).select("query_id", "raw_md5", "doc_id", "score", "rank"))


def select_last_per_source(spark, sf):
    """Of the first six rows of a question the selector names all; a file's last one counts."""
    hits = index.search(_document_index(spark, sf), _questions(spark, sf), 6)
    d = _table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_md5"), "source", F.col("text").alias("raw_text"))
    stage1 = hits.join(d, "doc_id").select("query_id", "rank", "doc_id", "source_md5", "source", "raw_text")
    picked = retrieval.select_rows(stage1, stage1, lambda prompt: F.sequence(F.lit(0), F.lit(5)))
    return _longs(picked.select("query_id", "source", "source_pos", "doc_id"))


def proximity_select(spark, sf):
    """R7 by reading the candidates: a question's first six rows, by how many of its terms they hold and how closely."""
    asked = _questions(spark, sf)
    hits = cut(index.search(_document_index(spark, sf), asked, 6).select("query_id", "rank", "doc_id"))
    few = F.broadcast(hits) if hits.count() <= index.BROADCAST_ROWS else hits
    found = _table(spark, sf, "documents").select("doc_id", "text").join(few, "doc_id")
    rows = cut(found.select("query_id", "rank", "doc_id", tx.clean_tokens(F.col("text")).alias("tokens")))
    best = proximity.in_order(rows, asked).join(rows.select("query_id", "rank", "doc_id"), ["query_id", "rank"])
    return _longs(best.select("query_id", "doc_id", "rank", "terms", "width", "place"))


def dynamic_k(spark, sf):
    """K4, A9."""
    d = _table(spark, sf, "documents").groupBy("lang").agg(F.count_distinct("source").alias("n_docs"))
    q = F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("n_queries")
    return _longs(d.select("lang", "n_docs", q).withColumn("k", retrieval.dynamic_k(12_000, 100, 3, F.col("n_docs"), F.col("n_queries"))))


def pair_centre(spark, sf):
    """R8 for two intervals, by the same function as for any number: apart, one in the other, or overlapping."""
    c = _small(spark, sf).groupBy("source").agg(F.max("win_hi").alias("m"), F.count("*").cast("int").alias("n"))
    lo, second = F.length("source") % 7, F.length("source") % 7 + F.col("n") % 8
    pair = F.array(F.struct(lo.alias("lo"), (lo + 5).alias("hi")), F.struct(second.alias("lo"), (second + F.col("m") % 5 + F.length("source") % 3).alias("hi")))
    return _longs(c.select("source", F.element_at(interval_centres(pair), 1).alias("centre")))


def interval_centroids(spark, sf):
    """The windows of each file's chunks in order of their digests, in sets of seven."""
    from pyspark.sql import Window

    small = chunking.add_windows(chunking.split_by_words(_pages(spark, sf), 10), 3, 18).withColumn("order", F.md5("raw_text"))
    n = F.row_number().over(Window.partitionBy("source").orderBy("order", "small_chunk_idx"))
    rows = small.withColumn("set_no", F.floor((n - 1) / 7)).groupBy("source", "set_no").agg(F.array_sort(F.collect_list(F.struct("order", "small_chunk_idx", F.col("win_lo").alias("lo"), F.col("win_hi").alias("hi")))).alias("x"))
    pairs = F.transform("x", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi")))
    return rows.select("source", "set_no", F.array_join(interval_centres(pairs).cast("array<string>"), ",").alias("centres"))


def history_render(spark, sf):
    """X9."""
    return conversation.render_history(_table(spark, sf, "conversations"))


def history_suffix(spark, sf):
    """W5, L15."""
    kept = conversation.recent_turns(_table(spark, sf, "conversations"), 120)
    return _longs(kept.select("conv_id", "turn", F.col("held").cast("long").alias("held")))


def question_split(spark, sf):
    """A model's answers, made up from conversations in three forms."""
    c = _table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[\r\n]", " ").alias("t"))
    answer = F.when(F.pmod("conv_id", F.lit(3)) == 0, F.concat(F.lit("1. "), "t", F.lit("\n2. why "), "t")).when(F.pmod("conv_id", F.lit(3)) == 1, F.concat(F.lit("(1) "), "t", F.lit("\n\nQuery: again"))).otherwise(F.concat(F.lit("Standalone questions: \n"), F.lit("what is "), "t"))
    return _longs(c.select("conv_id", "turn", F.array_join(tx.standalone_questions(answer), "|").alias("questions")))


def id_parse(spark, sf):
    """X11, R7."""
    c = _table(spark, sf, "conversations").select("conv_id", "turn")
    answer = F.when(F.pmod("turn", F.lit(3)) == 0, F.concat(F.lit("I pick ["), F.col("conv_id").cast("string"), F.lit(", 2,"), F.col("turn").cast("string"), F.lit("] and [9]"))).when(F.pmod("turn", F.lit(3)) == 1, F.lit("none: []")).otherwise(F.lit("[7]"))
    return _longs(c.select("conv_id", "turn", F.array_join(tx.chosen_ids(answer).cast("array<string>"), ",").alias("ids")))


def snippet_render(spark, sf):
    """The selector's view of each language's longest documents."""
    from pyspark.sql import Window

    d = _table(spark, sf, "documents").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))).where("rank <= 5")
    line = tx.snippet(F.col("rank") - 1, F.col("text"), F.col("source"))
    rows = d.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return rows.select("lang", F.array_join("x.line", "\n\n\n").alias("snippets"))


def context_assemble(spark, sf):
    """Sources as files, languages as questions, fifty documents in a row as a conversation."""
    d = _table(spark, sf, "documents")
    rows = d.select(F.expr("cast(substring(source, 4) as int)").alias("file_pos"), F.col("source").alias("file_name"), F.expr("cast(ascii(lang) as int)").alias("question_pos"), F.col("doc_id").alias("pos"), F.expr("cast(doc_id % 50 as int)").alias("medium_chunk_idx"), F.md5("text").alias("raw_md5"), F.col("text").alias("raw_text"), F.expr("doc_id div 50").alias("conv_id"))
    return conversation.assemble(rows, ("conv_id",))


def _stores(spark, sf):
    """The stores of all documents, built once a session for the same files."""
    return stored(spark, f"{sf}/documents.parquet", "stores", lambda folder: build_stores(_pages(spark, sf), folder))


def three_stage(spark, sf):
    """R5, R9, §3.2: all questions over chunks of whole documents, with the first two rows selected."""
    embed = get_embedding("hashing")
    s = _stores(spark, sf)
    b = _table(spark, sf, "benchmark")
    q = b.select(F.col("item_id").alias("query_id"), F.lit(1).alias("num_query"), tx.clean_tokens(F.col("text")).alias("tokens"), embed(F.col("text")).alias("embedding"))
    return _longs(retrieval.retrieve(s.small, s.medium, cut(q), lexical=s.lexical).select("query_id", "source_pos", "file_name", "medium_chunk_idx", "raw_md5", "rank"))


def speaker_strip(spark, sf):
    """A typed line without its speaker; parts of a model's name."""
    c = _table(spark, sf, "conversations")
    typed = F.concat(tx.speaker(F.col("role")), "text")
    parts = tx.model_parts(F.concat_ws("|", "role", F.col("conv_id").cast("string"), F.lit("file.gguf")))
    return c.select("conv_id", "turn", tx.strip_speaker(typed).alias("line"), parts[0].alias("provider"), parts[1].alias("model"), parts[2].alias("file"))


def prompt_refine(spark, sf):
    """The prompt that asks for standalone questions, for each conversation's last turn."""
    c = _table(spark, sf, "conversations")
    last = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
    full = conversation.render_history(c).join(last, "conv_id")
    return full.select("conv_id", F.md5(prompts.refine("stub", F.lit("a.txt, b.txt"), F.col("history"), F.col("question"))).alias("prompt_md5"), F.md5(prompts.refine("llama", F.lit("a.txt"), F.col("history"), F.col("question"))).alias("wrapped_md5"))


def prompt_answer(spark, sf):
    """Selection and answer prompts, plain and as messages."""
    c = _table(spark, sf, "conversations")
    chat = prompts.answer("stub", F.col("text"), F.col("role"), F.lit("why?"), chat=True)
    plain = prompts.answer("stub", F.col("text"), F.col("role"), F.lit("why?"))
    pick = prompts.select("stub", F.col("text"), F.lit("why?"))
    return c.select("conv_id", "turn", F.md5(pick).alias("select_md5"), F.md5(plain).alias("plain_md5"), F.md5(chat[0]["text"]).alias("system_md5"), chat[1]["text"].alias("human"))


def chunk_recursive(spark, sf):
    """C2 with separators, tried from coarse to fine."""
    return _longs(chunking.split_recursively(_pages(spark, sf), 100, 10).select("source", "small_chunk_idx", "n_chunks", F.md5("raw_text").alias("raw_md5")))


def hashed_embedding(spark, sf):
    """Unit vectors of a built-in provider, by their first components."""
    v = get_embedding("hashing")(F.col("text"))
    return _table(spark, sf, "benchmark").select("item_id", v.alias("v")).select("item_id", F.round(F.col("v")[0].cast("double"), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 6).alias("norm"))


def answered_turns(spark, sf):
    """Whole turns over all documents with the stub model: each conversation's last turn is its input, those before it its history."""
    s = _stores(spark, sf)
    c = _table(spark, sf, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"), F.max_by("text", "turn").alias("text"))
    asked = last.select("conv_id", F.concat(F.lit("Human: "), F.regexp_replace(F.coalesce("text", F.lit("")), "[\\r\\n]", " ")).alias("question"))
    turns = c.join(last.select("conv_id", "last"), "conv_id").where("turn < last").drop("last")
    out = conversation.answer_turns(asked, turns, s.small, s.medium, lexical=s.lexical)
    return out.select("conv_id", F.array_join("questions", "|").alias("questions"), F.md5("context").alias("context_md5"), F.md5("answer").alias("answer_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        list_files, file_names, token_lengths, bpe_token_lengths, chunk_tokens, chunk_small, chunk_overlap, chunk_windows, chunk_windows_fine, chunk_medium, chunk_medium_misaligned, chunk_rollup, ingested_files, incremental_ingest, enrich_md5, clean_tokens, lemma_tokens, lemma_documents, learnt_abbreviations, word_tokens,
        filter_and_or, filter_ranges, filter_ignore_empty, value_index_and_or, value_index_ignore_empty, set_operations, window_stab, bm25_top3, bm25_per_file, vector_topk, vector_topk_filtered, vector_approximate, mmr, rrf_fuse, rrf_dup_text,
        select_last_per_source, proximity_select, dynamic_k, pair_centre, interval_centroids, history_render, history_suffix, streamed_memory, question_split, id_parse, snippet_render, context_assemble, three_stage,
        speaker_strip, prompt_refine, prompt_answer, chunk_recursive, hashed_embedding, answered_turns,
    )
}
