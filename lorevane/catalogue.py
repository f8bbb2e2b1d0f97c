"""The queries over the library's own operators, and the SQL that gives the same rows.

The tables have no downloads, grids or PDFs, so some inputs are derived from table columns, in Spark and in SQL alike.
Searches take every vector whose id is divisible by 20 as a query; the one after it stands for its expanded form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import tables
from .functions import text as T
from .operators import conversation as C
from .operators import grids as G
from .operators import links as L
from .operators import retrieval as R
from .operators import vector_index as V
from .plans import assistant as A
from .plans.folders import working_folder
from .sources import files as S
from .sources import folder_source

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
#: The same white space as functions.text.WHITESPACE, as RE2 writes it.
_WS = "\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_STRIP = f"regexp_replace(%s, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")


def _asked(nodes: DataFrame, after: int = 0) -> DataFrame:
    """The query vectors: ids divisible by 20, or those `after` them as another form of the same queries."""
    return nodes.where(F.col("node_id") % 20 == after).select((F.col("node_id") - after).alias("query_id"), "embedding")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("hour", F.hour("ts"))


# Retrieval


def sentence_window(spark, sf_dir):
    return R.document_windows(_table(spark, sf_dir, "documents")).select("doc_id", F.col("ord").cast("long").alias("ord"), "window")


def topk_cosine(spark, sf_dir):
    nodes = _vectors(spark, sf_dir)
    return R.top_k(_asked(nodes), nodes).select("query_id", "node_id", F.round("score", 6).alias("score"), F.col("pos").cast("long").alias("pos"))


_CLUSTERED = "transform(embedding, (x, i) -> CAST(x AS DOUBLE) * CAST(0.1 AS DOUBLE) + IF(i = label, 1D, 0D))"


def topk_index(spark, sf_dir):
    """The nearest nodes from a stored index, of vectors that lie around one direction for each label."""
    nodes, path = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.expr(_CLUSTERED).alias("embedding")), working_folder(spark)
    V.build(nodes, path)
    return V.search(_asked(nodes), path).select("query_id", "node_id", F.round("score", 6).alias("score"), F.col("pos").cast("long").alias("pos"))


def _held(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """Documents with what an index compares and keeps."""
    said = F.expr(text) if isinstance(text, str) else text
    return docs.select("doc_id", said.alias("text")).withColumn("hash", F.sha2("text", 256))


def _as_nodes(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"node_id": F.col("doc_id"), "embedding": _letters(F.col("text"))})


def _letters(text: Column) -> Column:
    """An embedder that SQL has too: how often each letter occurs."""
    return R.once(F.lower(F.coalesce(text, F.lit(""))), lambda t: F.array(*((F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double") for c in _ALPHABET)))


_ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def index_upkeep(spark, sf_dir):
    """An index of two thirds of the documents, brought to the whole table less some in two rounds of differences."""
    docs, path = _table(spark, sf_dir, "documents"), working_folder(spark)
    V.build(_as_nodes(_held(docs.where("doc_id % 3 <> 0"))), path)
    V.refresh(spark, path, _held(docs.where("doc_id % 7 <> 1"), "CASE WHEN doc_id % 5 = 1 THEN text || ' again' ELSE text END"), _as_nodes, 1)
    V.refresh(spark, path, _held(docs.where("doc_id % 11 <> 1"), "CASE WHEN doc_id % 5 = 1 THEN text || ' at last' ELSE text END"), _as_nodes, 2)
    return V.load(spark, path).select("doc_id", F.md5("text").alias("text"))


def index_stream(spark, sf_dir):
    """The same upkeep from a stream of changes: documents come, some of them change, some of them go, in that order."""
    docs, path, log = _table(spark, sf_dir, "documents"), working_folder(spark), working_folder(spark)
    V.build(_as_nodes(_held(docs.where("doc_id % 20 = 0"))), path)
    for n, (which, text) in enumerate((("doc_id % 20 <> 0", "text"), ("doc_id % 5 = 1", "text || ' again'"), ("doc_id % 7 = 1", "text"))):
        _held(docs.where(which), text).withColumns({"deleted": F.lit(n == 2), "n": F.lit(n)}).write.mode("append").parquet(log)
    changes = spark.readStream.schema(spark.read.parquet(log).schema).option("maxFilesPerTrigger", 16).parquet(log)
    V.upkeep(changes, path, _as_nodes, working_folder(spark)).awaitTermination()
    return V.load(spark, path).select("doc_id", F.md5("text").alias("text"))


def _dual(spark, sf_dir):
    nodes = _vectors(spark, sf_dir)
    return R.merge_hits(R.top_k(_asked(nodes), nodes), R.top_k(_asked(nodes, 1), nodes), ("query_id",))


def dual_retrieval_merge(spark, sf_dir):
    return _dual(spark, sf_dir).select("query_id", "node_id", F.round("score", 6).alias("score"), F.col("pos").cast("long").alias("pos"))


def rerank_batches(spark, sf_dir):
    nodes = _vectors(spark, sf_dir)
    return R.batches(R.top_k(_asked(nodes), nodes)).select("query_id", "node_id", F.col("batch").cast("long").alias("batch"))


def retrieval_answer(spark, sf_dir):
    """For every query two retrievals, merge, rerank by token overlap with the query's document, the window around the node's
    sentence, and labels. Vector v belongs to document v % n, and there to sentence v % (its number of sentences)."""
    docs = _table(spark, sf_dir, "documents")
    n = docs.agg(F.count("*").alias("n"))  # one row
    of = lambda df, c: df.crossJoin(F.broadcast(n)).withColumn("doc_id", F.col(c) % F.col("n")).drop("n")
    hits = of(_dual(spark, sf_dir), "node_id")
    asked = of(_asked(_vectors(spark, sf_dir)).select("query_id"), "query_id").join(docs.select("doc_id", F.col("text").alias("question")), "doc_id").drop("doc_id")
    found = docs.select("doc_id", "text", "source").join(hits, "doc_id").join(asked, "query_id")
    best = R.rerank(found, F.col("question"), F.col("text"), by=("query_id",))
    window = R.once(R.windows_of(R.sentence_list(F.col("text"))), lambda w: F.when(F.size(w) > 0, F.get(w, (F.col("node_id") % F.greatest(F.size(w), F.lit(1))).cast("int"))))
    noted = best.withColumn("metadata", F.create_map(F.lit("file_name"), F.col("source"), F.lit("window"), window))
    return R.widen(noted).select("query_id", F.col("rank").cast("long").alias("rank"), "node_id", "doc_id", F.round("relevance", 6).alias("relevance"), T.source_label(F.col("metadata")).alias("label"), F.col("text").alias("window"))


def cited_answers(spark, sf_dir):
    """The passages that each query found, as an answer with its sources; every second query finds blank ones only."""
    docs = _table(spark, sf_dir, "documents")
    hits = R.top_k(_asked(_vectors(spark, sf_dir)), _vectors(spark, sf_dir)).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))
    text = F.when(F.col("query_id") % 40 == 0, F.lit(" ")).otherwise(F.col("text"))
    found = hits.withColumn("doc_id", F.col("node_id") % F.col("n")).join(docs.select("doc_id", "text", _metadata().alias("metadata")), "doc_id")
    made = R.answer(found.withColumn("text", text), "query_id", order="pos")
    return made.select("query_id", F.md5("answer").alias("answer"), F.array_join("sources", ";").alias("sources"))


def paired_sources(spark, sf_dir):
    """Hits from frequent questions, which every third vector stands for, behind those from regulations."""
    named = _dual(spark, sf_dir).withColumn("file_name", F.when(F.col("node_id") % 3 == 0, "常見問題.pdf").otherwise("rules.pdf"))
    return R.paired(named, order="pos").select("query_id", "node_id", "basis", F.col("place").cast("long").alias("place"))


def latest_rules(spark, sf_dir):
    """The document of each source with the latest year; a quarter of them name none."""
    dated = _table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.concat((100 + F.col("doc_id") % 17).cast("string"), F.lit(" 學年度 "), "text")))
    return R.prefer_latest(dated, "source").select("source", F.md5("text").alias("text"))


def noise_filter(spark, sf_dir):
    noted = _table(spark, sf_dir, "documents").withColumn("text", F.expr("CASE doc_id % 10 WHEN 0 THEN text || ' 匯款帳號 1' WHEN 5 THEN '獎金' || text ELSE text END"))
    return R.without_noise(noted).select("doc_id", F.md5("text").alias("text"))


def inherited_rules(spark, sf_dir):
    """Customers as departments and nations as colleges: the rule of the nearest one that has any."""
    customers = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("unit"), F.concat(F.lit("n"), "c_nationkey").alias("above"), F.col("c_mktsegment").alias("topic"), "c_acctbal", "c_nationkey")
    own = customers.where("c_acctbal > 5000").select("unit", "topic", F.floor("c_acctbal").cast("string").alias("rule"))
    over = customers.where("c_nationkey % 3 = 0").select(F.col("above").alias("unit"), "topic", F.concat(F.lit("as in "), "above").alias("rule")).distinct()
    general = customers.where("topic <> 'MACHINERY'").select(F.lit("*").alias("unit"), "topic", F.lit("general").alias("rule")).distinct()
    return R.inherited(customers.select("unit", "topic"), own.union(over).union(general), customers.select("unit", "above")).select("unit", "topic", "rule", "source_unit")


def apologies(spark, sf_dir):
    answers = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("answer"), F.array("role").alias("sources"), F.when(F.col("turn") % 3 == 0, "failed").alias("error"))
    return R.apologise(answers).select("conv_id", "turn", "answer", F.array_join("sources", ";").alias("sources"))


def prompt_fill(spark, sf_dir):
    """A template in which a text stands that itself looks like a place."""
    filled = T.fill("From {source}:\n{text}\n({source}, {lang})", source=F.col("source"), text=F.concat(F.lit("{lang}"), "text"), lang=F.col("lang"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(filled).alias("prompt"))


_INTENT = "CASE length({0}) % 5 WHEN 0 THEN 'CLARIFY' WHEN 1 THEN 'ACTION' ELSE 'ACADEMIC' END"
_TO_FILE = "CASE doc_id % 6 WHEN 0 THEN '常見問題 ' WHEN 1 THEN '113 學年度 ' WHEN 2 THEN '114 學年度 ' ELSE '' END || source"
_RULED = "CASE doc_id % 9 WHEN 0 THEN '資工系 ' WHEN 1 THEN '資電學院 ' WHEN 2 THEN '全校 ' WHEN 3 THEN '匯款帳號 ' ELSE '' END || text"
_REQUEST = "CASE turn % 6 WHEN 2 THEN '那資工系呢' WHEN 4 THEN text || ' 碩士班' ELSE text END"
_COLLEGES = (("企管系", "管理學院"), ("資工系", "資電學院"))


def _sources_of_chat(spark, sf_dir):
    """Documents as files of some years and levels, and the models and the requests of all user turns over them."""
    models = A.Models(embed=_letters, classify=lambda text: F.when(F.length(text) % 5 == 0, "CLARIFY").when(F.length(text) % 5 == 1, "ACTION").otherwise("ACADEMIC"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_RULED).alias("text"), F.create_map(F.lit("file_name"), F.expr(_TO_FILE)).alias("metadata"))
    requests = _user_turns(spark, sf_dir).select(F.col("conv_id").alias("thread_id"), "turn", F.expr(_REQUEST).alias("user_message"))
    return docs, requests, models, spark.createDataFrame(list(_COLLEGES), "department string, college string")


def _shown(replies: DataFrame) -> DataFrame:
    return replies.select("thread_id", "turn", "next_agent", F.md5("answer").alias("answer"), F.array_join("sources", ";").alias("sources"))


def chat_answers(spark, sf_dir):
    """Every user turn as a question over the documents' sentences; turns take the agents in rotation, most of them retrieval."""
    docs, requests, models, colleges = _sources_of_chat(spark, sf_dir)
    path = working_folder(spark)
    A.index(docs, path, models)
    return _shown(A.chat(requests, path, models, colleges=colleges))


def chat_stream(spark, sf_dir):
    """The same questions as a stream in three parts, each with the threads' earlier turns as its history."""
    from .plans import streams

    docs, requests, models, colleges = _sources_of_chat(spark, sf_dir)
    path, folder, log, out, checkpoint = (working_folder(spark) for _ in range(5))
    A.index(docs, path, models)
    for part in ("turn < 2", "turn >= 2 AND turn < 4", "turn >= 4"):
        requests.where(part).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(requests.schema).parquet(folder)
        streams.answer_stream(stream, path, log, out, checkpoint, models=models, colleges=colleges).awaitTermination()
    return _shown(spark.read.parquet(out))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_answer(spark, sf_dir)


def _metadata() -> Column:
    """file_name unless doc_id ends in 9, page_label for even ids."""
    name = F.when(F.col("doc_id") % 10 != 9, F.col("source"))
    page = F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 5).cast("string"))
    return F.map_filter(F.create_map(F.lit("file_name"), name, F.lit("page_label"), page), lambda k, v: v.isNotNull())


def ordered_sources(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("metadata", _metadata())
    return R.ordered_sources(docs, "lang", order="doc_id").select("lang", F.array_join("sources", ";").alias("sources"))


def source_labels(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.source_label(_metadata()).alias("label"))


def label_file_name(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.label_file(T.source_label(_metadata())).alias("file_name"))


# Conversations


def _user_turns(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").where("role = 'user'")


def history_last3(spark, sf_dir):
    return C.recent(_user_turns(spark, sf_dir)).select("conv_id", "turn", "history")


def last_result(spark, sf_dir):
    return C.last_state(_table(spark, sf_dir, "conversations"), ["role", "text"]).select("conv_id", "role", "text")


def appended_results(spark, sf_dir):
    return C.appended_state(_table(spark, sf_dir, "conversations"), "text").select("conv_id", F.array_join("text", "\u0001").alias("texts"))


_SAID = "text || CASE turn % 4 WHEN 0 THEN ' action. ' WHEN 1 THEN ' Clarify or academic' WHEN 2 THEN ' the academic ' ELSE '' END"
_ASKED = "text || CASE turn % 5 WHEN 0 THEN '，幫我辦' WHEN 1 THEN '，幫我看看多少錢' WHEN 2 THEN '畢業門檻' ELSE '' END"
_NARROWED = "text || CASE turn % 7 WHEN 1 THEN ' 資工系' WHEN 4 THEN ' 碩士班' ELSE '' END"
_FOLLOWED = "CASE turn % 6 WHEN 2 THEN '那企管系呢' WHEN 4 THEN '碩士班的' ELSE text END"


def intent_route(spark, sf_dir):
    """Whole texts as a model's labels, most of them with a word that decides."""
    return C.route(_table(spark, sf_dir, "conversations"), F.expr(_SAID)).select("conv_id", "turn", "next_agent", "node")


def keyword_route(spark, sf_dir):
    return C.route(_table(spark, sf_dir, "conversations").withColumn("text", F.expr(_ASKED))).select("conv_id", "turn", "next_agent")


def clarify_needed(spark, sf_dir):
    return C.needs_clarification(_table(spark, sf_dir, "conversations").withColumn("text", F.expr(_NARROWED))).select("conv_id", "turn", "clarify")


def query_expansion(spark, sf_dir):
    colleges = spark.createDataFrame([("企管系", "管理學院"), ("資工系", "資電學院")], "department string, college string")
    return C.expansion(_table(spark, sf_dir, "conversations").withColumn("text", F.expr(_FOLLOWED)), colleges).select("conv_id", "turn", "department", "degree", "expanded")


def _replies(spark, sf_dir):
    held = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"), F.max_by("role", "turn").alias("agent"), F.array_sort(F.collect_set("role")).alias("sources"))
    return held.select("conv_id", C.reply(F.col("t.text"), F.col("sources"), F.col("agent")).alias("reply"))


def reply_json(spark, sf_dir):
    return _replies(spark, sf_dir)


def response_decode(spark, sf_dir):
    """What the chat front reads from a reply; every fifth is cut off."""
    sent = _replies(spark, sf_dir).withColumn("reply", F.when(F.col("conv_id") % 5 == 0, F.left("reply", F.lit(7))).otherwise(F.col("reply")))
    read = sent.select("conv_id", C.response(F.col("reply")).alias("r"))
    return read.select("conv_id", F.col("r.answer").alias("answer"), F.array_join("r.sources", ";").alias("sources"))


def last_three(spark, sf_dir):
    held = C.appended_state(_table(spark, sf_dir, "conversations"), "text")
    return held.select("conv_id", F.array_join(T.last_of(F.col("text"), 3), "\u0001").alias("texts"))


def page_concat(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(C.joined_pages("turn").alias("text"), C.joined_pages("turn", ocr=True).alias("ocr_text"))


def page_carry(spark, sf_dir):
    return C.page_carry(_table(spark, sf_dir, "conversations")).select("conv_id", "turn", "carry")


def page_fold(spark, sf_dir):
    """Turns as pages that are transcribed in order, each beginning with the end of the one before."""
    pages = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), F.col("text").cast("binary").alias("image"))
    made = S.carry_pages(pages, lambda image, before: before[-3:] + bytes(image).decode(), key="conv_id")
    return made.select("conv_id", F.col("page").cast("long").alias("turn"), "text")


def message_log(spark, sf_dir):
    """Messages added to a log in two parts."""
    turns, path = _table(spark, sf_dir, "conversations"), working_folder(spark)
    for part in (0, 1):
        C.append_messages(turns.where(F.col("turn") % 2 == part).select("conv_id", "turn", "role", "text"), path)
    return spark.read.parquet(path)


# Links


def _anchors(spark, sf_dir):
    return L.anchors(_table(spark, sf_dir, "pages"))


def link_resolve(spark, sf_dir):
    return _anchors(spark, sf_dir).select("page_id", F.col("ord").cast("long").alias("ord"), L.resolve(F.col("url"), F.col("href")).alias("full_url"))


def link_first_writer(spark, sf_dir):
    named = _anchors(spark, sf_dir).withColumn("name", T.safe_name(T.first_line("txt")))
    return L.first_writer(named.where("name <> ''"), "name", ["page_id", "ord"]).select("name", "page_id", F.col("ord").cast("long").alias("ord"))


_HREF = "CASE ord % 7 WHEN 0 THEN '#' WHEN 1 THEN 'javascript:' || href WHEN 2 THEN href || '.ODT' WHEN 3 THEN href || '.DOCX' WHEN 4 THEN '/profile' || href WHEN 5 THEN href || '.pdf' ELSE href END"
_NAME = "CASE ord % 5 WHEN 0 THEN '某測試用檔案' || txt WHEN 1 THEN '檔案下載' WHEN 2 THEN '3. ' || txt || '.PDF' WHEN 3 THEN txt || '.docx' ELSE txt END"
_TXT = "CASE ord % 4 WHEN 0 THEN '3. 下載' WHEN 1 THEN txt WHEN 2 THEN 'ab' ELSE 'FILE' END"
_ROW = "CASE page_id % 2 WHEN 0 THEN 'row of ' || txt ELSE 'x' END"


def _derived(spark, sf_dir):
    """The links of all pages with hrefs and names that filters tell apart."""
    return _anchors(spark, sf_dir).withColumn("txt", T.first_line("txt")).select("page_id", F.col("ord").cast("long").alias("ord"), F.expr(_HREF).alias("href"), F.expr(_NAME).alias("name"), F.expr(_TXT).alias("txt"), F.expr(_ROW).alias("tr_text"))


def link_filter(spark, sf_dir):
    kept = _derived(spark, sf_dir).where(L.wanted(F.col("href")))
    return kept.select("page_id", "ord", "href", L.extension(F.col("href"), F.col("name")).alias("ext"))


def blacklist(spark, sf_dir):
    return _derived(spark, sf_dir).where(~L.blacklisted(F.col("name"))).select("page_id", "ord", T.without_extension(T.safe_name(T.without_number("name"))).alias("name"))


def link_names(spark, sf_dir):
    """Names of links, from the table row where their text says nothing."""
    return _derived(spark, sf_dir).select("page_id", "ord", L.link_name(F.col("txt"), F.col("tr_text")).alias("name"))


def anti_existing(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    named = lambda df: L.anchors(df).select("page_id", T.first_line("txt").alias("file_name"))
    existing = named(pages.where("page_id % 3 = 0")).select("file_name")
    return L.without_existing(named(pages), existing, F.col("file_name")).groupBy("page_id").agg(F.count("*").alias("n"))


def link_tally(spark, sf_dir):
    """How many links each page has, and how many names it was the first to give."""
    named = _anchors(spark, sf_dir).withColumn("name", T.safe_name(T.first_line("txt")))
    return L.tally(named, L.first_writer(named.where("name <> ''"), "name", ["page_id", "ord"]), "page_id").select("page_id", "links", "files")


def stored_downloads(spark, sf_dir):
    """Files stored once under each name, with their number."""
    named = _anchors(spark, sf_dir).withColumn("file_name", T.safe_name(T.first_line("txt"))).where("file_name <> ''")
    path = working_folder(spark)
    n = L.store(L.first_writer(named, "file_name", ["page_id", "ord"]).select("file_name", F.col("href").cast("binary").alias("content")), path)
    return spark.read.parquet(path).select("file_name", F.md5("content").alias("content"), F.lit(n).alias("stored"))


def committed_files(spark, sf_dir):
    """Link names stored twice as files by the committing sink, and read back by the data source with a filter on names."""
    folder_source.register(spark)
    path = working_folder(spark)
    named = _anchors(spark, sf_dir).withColumn("file_name", T.safe_name(T.first_line("txt"))).where("file_name <> '' AND octet_length(file_name) < 200")
    first = L.first_writer(named, "file_name", ["page_id", "ord"])
    for content in (F.col("href"), F.concat("href", F.lit(" again"))):
        first.select("file_name", content.cast("binary").alias("content")).write.format("folder").mode("append").save(path)
    read = folder_source.files(spark, path, least=6).where("file_name > 'B'")
    return read.select("file_name", "length", F.md5("content").alias("content"), "error")


def _getter(url: str) -> tuple[int, bytes]:
    if url.endswith("3"):
        raise OSError("no route")
    return (404 if url.endswith("7") else 200), url.upper().encode()


def fetch_pages(spark, sf_dir):
    """Every page's url through a getter that fails for some."""
    from .sources import web

    got = web.fetch(_table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("full_url")), _getter)
    html = web.decoded(got).select("page_id", F.col("html").alias("body"))
    return got.select("page_id", F.coalesce("status", F.lit(0)).cast("long").alias("status"), "error").join(html, "page_id", "left")


def url_quote(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(T.quote_path("text")).alias("quoted"))


def text_clean(spark, sf_dir):
    wrapped = F.concat(F.lit("```markdown\nhere is the file\n\n"), F.col("text"), F.lit("\n```\n\nHope this helps! z"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_transcript(wrapped)).alias("cleaned"))


# Tables and grids


def text_lines(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(T.lines("text")).cast("long").alias("n"), F.md5(F.array_join(T.lines("text"), "|")).alias("lines"), F.md5(T.first_line("text")).alias("first"))


def page_titles(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", L.page_title(F.col("text")).alias("title"))


def image_base64(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(T.data_url(F.col("text").cast("binary"))).alias("url"))


def density_gate(spark, sf_dir):
    """Every text cut at its bars into cells; one document in 97 cannot be read."""
    docs = _table(spark, sf_dir, "documents")
    cells = docs.select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("tbl"), F.explode(F.split("text", "\\|")).alias("text"))
    return G.dense_tables(cells, docs.select("doc_id", (F.col("doc_id") % 97 != 0).alias("readable"))).select("doc_id", "has_table")


def density_semi(spark, sf_dir):
    """Documents as tables with their lines as cells: sources that have a dense one."""
    docs = _table(spark, sf_dir, "documents")
    cells = docs.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return G.dense_tables(cells, docs.select("source").distinct(), key="source", table=("doc_id",)).select("source", "has_table")


def _contents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id", F.lit(".pdf")).alias("path"), F.col("text").cast("binary").alias("content"))


def _parse_lines(path: str, content: bytes) -> list[str]:
    if path.endswith("7.pdf"):
        raise ValueError("broken")
    return content.decode().split("\n")


def parse_files(spark, sf_dir):
    """Documents as files whose lines are pages; a tenth cannot be read."""
    made = S.parsed(_contents(spark, sf_dir), _parse_lines)
    return made.select("path", F.coalesce("page", F.lit(-1)).cast("long").alias("page"), F.md5("text").alias("text"), "error")


def table_cells(spark, sf_dir):
    """Documents as one table each: lines are rows, bars end cells."""
    made = S.table_cells(_contents(spark, sf_dir), lambda path, content: [[[line.split("|") for line in _parse_lines(path, content)]]])
    return made.select("path", F.coalesce("r", F.lit(-1)).cast("long").alias("r"), F.coalesce("c", F.lit(-1)).cast("long").alias("c"), F.md5("text").alias("text"), "error")


def has_tables(spark, sf_dir):
    """The same files probed for dense tables; those that cannot be read count as having one."""
    return S.has_tables(_contents(spark, sf_dir), lambda path, content: [[[line.split("|") for line in _parse_lines(path, content)]]])


_FILE = "CASE doc_id % 6 WHEN 0 THEN '.' || doc_id || '.pdf' WHEN 1 THEN '~$' || doc_id || '.docx' WHEN 2 THEN doc_id || '.PDF' WHEN 3 THEN '_' || doc_id || '.docx' ELSE doc_id || '.pdf' END"


def loadable_files(spark, sf_dir):
    files = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_FILE).alias("file_name"), F.when(F.col("doc_id") % 10 == 4, 0).otherwise(F.octet_length("text")).alias("length"))
    return S.loadable(files).select("doc_id", "file_name", "kind")


def ingest_routes(spark, sf_dir):
    """Documents as files of both kinds: cached, with tables, plain, or .docx."""
    docs = _table(spark, sf_dir, "documents").withColumn("file_name", F.concat("doc_id", F.when(F.col("doc_id") % 4 == 0, ".docx").otherwise(".pdf")))
    files = docs.select(F.concat("source", F.lit("/"), "file_name").alias("path"), "file_name", F.col("text").alias("body"), "doc_id")
    cells = files.select("path", F.lit(0).alias("page"), F.lit(0).alias("tbl"), F.explode(F.split("body", "\\|")).alias("text"))
    probed = G.dense_tables(cells, files.where("doc_id % 7 <> 0").select("path"), key="path")
    cache = files.where("doc_id % 5 = 0").select("path", F.concat(F.lit("cached "), "body").alias("text"))
    as_is = lambda df: df.withColumn("text", F.col("body"))
    made = S.documents(files, cache, probed, as_is, lambda df: df.withColumn("text", F.reverse("body")), as_is)
    return made.select("file_name", "route", F.md5("text").alias("text"))


def transcript_cache(spark, sf_dir):
    """Transcripts written in two rounds, of which the second replaces a third of the first."""
    docs, path = _table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string")), working_folder(spark)
    S.write_transcripts(docs.select("path", F.lit(1.0).alias("mtime"), "text"), path)
    S.write_transcripts(docs.where("doc_id % 3 = 0").select("path", F.lit(2.0).alias("mtime"), F.concat("text", F.lit(" again")).alias("text")), path)
    return S.read_transcripts(spark, path).select("path", F.md5("text").alias("text"))


def index_swap(spark, sf_dir):
    """An index that was built twice, and its marker."""
    nodes, path = _vectors(spark, sf_dir), working_folder(spark)
    S.save_index(nodes.where("node_id % 2 = 0"), path, 1.0)
    S.save_index(nodes, path, 2.0)
    return S.load_index(spark, path).select("node_id", F.element_at("embedding", 1).cast("double").alias("first")).crossJoin(F.broadcast(S.load_marker(spark, path)))


def index_freshness(spark, sf_dir):
    """Events as files of their user's index; a third of the indexes has a marker, at the user's last click."""
    files = _files(spark, sf_dir)
    markers = files.where("user_id % 3 = 0 AND file_name = 'click'").groupBy("user_id").agg(F.max("mtime").alias("saved"))
    return S.freshness(files, markers, "user_id").select("user_id", "latest", "saved", "rebuild")


def _cells(spark, sf_dir):
    """Each user's events of an hour as a row of cells, one to three columns wide; every second user's rows come in pairs
    under a first cell that reaches over both."""
    order = Window.partitionBy("user_id", "hour").orderBy("event_id")
    events = _events(spark, sf_dir)
    numbered = events.select("user_id", "hour").distinct().withColumn("r", (F.row_number().over(Window.partitionBy("user_id").orderBy("hour")) - 1).cast("int"))
    cells = events.join(numbered, ["user_id", "hour"]).select(F.col("user_id").alias("table_id"), "r", F.row_number().over(order).alias("ord"), F.lit(1).alias("rowspan"), (1 + F.col("event_id") % 3).cast("int").alias("colspan"), F.col("event_type").alias("text"))
    heads = numbered.where("user_id % 2 = 0 AND r % 2 = 0").select(F.col("user_id").alias("table_id"), "r", F.lit(0).alias("ord"), F.lit(2).alias("rowspan"), F.lit(1).alias("colspan"), F.concat(F.lit("from "), "hour").alias("text"))
    return cells.unionByName(heads)


def span_expand(spark, sf_dir):
    return G.expand_spans(_cells(spark, sf_dir)).select("table_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "text")


def span_expand_sql(spark, sf_dir):
    """The same grid by a table function in SQL."""
    tables.register(spark)
    return spark.sql("SELECT * FROM expand_spans(TABLE({cells}) PARTITION BY table_id ORDER BY (r, ord))", cells=_cells(spark, sf_dir))


def html_links_sql(spark, sf_dir):
    """Links in nested markup with the text of the table row around each, by a table function in SQL."""
    tables.register(spark)
    row = F.concat(F.lit("<tr><td>No. "), "ord", F.lit("</td><td><div><span><a class=x href='"), "href", F.lit("'><b>"), T.escape_html("txt"), F.lit("</b></a></span></div></td></tr>"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", row.alias("row")))), lambda x: x["row"]), "")
    pages = L.anchors(_table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.concat(F.lit("<table><tr><td>all<table>"), listed, F.lit("</table></td></tr></table>")).alias("html"))
    return spark.sql("SELECT page_id, CAST(l.ord AS BIGINT) AS ord, l.href, l.txt, l.tr_text FROM {pages}, LATERAL html_links(html) AS l", pages=pages)




def html_timetable(spark, sf_dir):
    """Each user's events as a timetable in HTML, read back: cells, spans over rows, and one row for each filled cell."""
    cell = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.concat(x["event_type"], F.lit("#"), x["event_id"])), "<br>")
    day = lambda k: F.concat(F.lit("<td>"), F.coalesce(F.max(F.when(F.col("d") == k, F.col("cell"))), F.lit("")), F.lit("</td>"))
    filled = _events(spark, sf_dir).groupBy("user_id", "hour", (F.col("event_id") % 7).alias("d")).agg(cell.alias("cell"))
    rows = filled.groupBy("user_id", "hour").agg(F.concat(*(day(k) for k in range(7))).alias("days")).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("hour")))
    two = F.lpad(F.col("hour").cast("string"), 2, "0")
    row = F.concat(F.lit("<tr>"), F.when(F.col("n") % 2 == 1, "<td rowspan=2>half</td>").otherwise(""), F.lit("<td> P"), "hour", F.lit("</td><td>"), two, F.lit(":00<br>"), two, F.lit(":50</td>"), "days", F.lit("</tr>"))
    head = "<table id='AutoNumber1'><tr><th>午別</th><th>節次</th><th>時間</th>" + "".join(f"<th>{'' if k == 3 else f'D{k}'}</th>" for k in range(7)) + "</tr>"
    pages = rows.withColumn("row", row).groupBy(F.col("user_id").alias("table_id")).agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "row"))), lambda x: x["row"]), ""), F.lit("</table>")).alias("html"))
    found = G.unpivot(G.expand_spans(G.html_cells(pages, "table_id", table_id="AutoNumber1")))
    return found.select("table_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "day", "period", "time", "raw_content", F.array_join("details", ",").alias("details"))


def course_cells(spark, sf_dir):
    """The HTML of each user's hours, three texts to a course."""
    lists = _events(spark, sf_dir).withColumn("details", F.array(F.concat(F.lit("<"), "event_type"), F.col("event_id").cast("string")))
    held = G.accumulate(lists, ["user_id", "hour"], "event_id")
    return held.select("user_id", F.col("hour").cast("long").alias("hour"), G.course_cell(F.col("details")).alias("cell"))


def pivot_fixed_domain(spark, sf_dir):
    wide = G.pivot_counts(_events(spark, sf_dir), "hour", "event_type", EVENT_TYPES)
    return wide.withColumn("hour", F.col("hour").cast("long"))


def _courses(spark, sf_dir):
    """All events as courses of their users: the hour names the period, the id the day; hours past the last period have none."""
    names, days = (F.array(*(F.lit(x) for x in y)) for y in ([p.replace("Ａ", "A") for p, _ in G.PERIODS], [*G.DAYS, "星期日"]))
    return _events(spark, sf_dir).select("user_id", F.get(names, F.col("hour")).alias("period"), F.get(days, (F.col("event_id") % 7).cast("int")).alias("day"), F.col("event_id").alias("ord"), F.array(F.col("event_id").cast("string"), F.col("event_type")).alias("details"))


def grid_fill(spark, sf_dir):
    grid = G.timetable(_courses(spark, sf_dir), key="user_id")
    return grid.select("user_id", "period", "time", *(F.array_join(d, ",").alias(f"d{i}") for i, d in enumerate(G.DAYS)))


def keyed_accumulate(spark, sf_dir):
    lists = _events(spark, sf_dir).withColumn("details", F.array(F.col("event_type"), F.col("event_id").cast("string")))
    return G.accumulate(lists, ["user_id", "hour"], "event_id").select("user_id", F.col("hour").cast("long").alias("hour"), F.array_join("details", ",").alias("details"))


def chunk3(spark, sf_dir):
    chunks = G.list_chunks(_events(spark, sf_dir), "user_id", "event_id", "event_type")
    return chunks.select("user_id", F.col("n").cast("long").alias("n"), F.array_join("chunk", "/").alias("chunk"))


_LISTED = """CASE event_id % 8 WHEN 0 THEN event_type WHEN 1 THEN '[[{''day'': ''' || event_type || ''', ''details'': [''' || user_id || ''', ''x'']}]]'
 WHEN 2 THEN '[{"day": "' || event_type || '", "details": ["' || user_id || '", "x"]}]' WHEN 3 THEN '[{''day'': ''' || event_type || ''', ''time'': None, ''details'': [''' || user_id || ''', ''x'']}]'
 ELSE ' [{''day'': ''' || event_type || ''', ''details'': [''' || user_id || ''', ''x'']}]' END"""


def parse_lists(spark, sf_dir):
    """Course lists written as Python literals or JSON, nested or not, and texts that are none."""
    parsed = _table(spark, sf_dir, "events").select("event_id", "event_type", G.parse_list(F.expr(_LISTED)).alias("list"))
    return parsed.select("event_id", F.coalesce(F.get("list", 0)["day"], F.concat(F.lit("text "), "event_type")).alias("day"), F.array_join(F.get("list", 0)["details"], ",").alias("details"))


_MIXED = """CASE event_id % 7 WHEN 0 THEN event_type WHEN 1 THEN '[[]]' WHEN 2 THEN '  '
 WHEN 3 THEN ' [[[{''day'': ''' || event_type || ''', ''details'': [' || user_id || ', ''x'']}]]]' WHEN 4 THEN '[{"day": "' || event_type || '", "more": {"k": [1]}, "details": ["' || user_id || '"]}]'
 WHEN 5 THEN '[1, ' || user_id || ']' ELSE '[[{''day'': ''' || event_type || ''', ''time'': None}, {''day'': ''second''}]]' END"""


def tagged_replies(spark, sf_dir):
    """Replies that are texts, nothing, or course lists of some depth, told apart and read as variants."""
    read = _table(spark, sf_dir, "events").select("event_id", G.read_reply(F.expr(_MIXED)).alias("r"))
    first = F.get("r.courses", 0)
    return read.select("event_id", "r.kind", "r.text", F.coalesce(F.size("r.courses"), F.lit(0)).cast("long").alias("n"), first["day"].alias("day"), F.array_join(first["details"], ",").alias("details"))


def _files(spark, sf_dir):
    """Events as files; those of type view are hidden."""
    return _table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "view", ".view").otherwise(F.col("event_type")).alias("file_name"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) / 1e6").alias("mtime"))


def latest_mtime(spark, sf_dir):
    return S.latest_mtime(_files(spark, sf_dir))


def history_stream(spark, sf_dir):
    """history_last3 as a stream over the table's files, with the threads' texts as state; the stream ends with its input."""
    from .plans.streams import history_to_table

    return history_to_table(spark, f"{sf_dir}/conversations.parquet", "role = 'user'")


def history_corrections(spark, sf_dir):
    """history_last3 over turns that come in three parts, a third of each thread's turns in each, so most come late."""
    from .plans import streams

    turns = _user_turns(spark, sf_dir).select("conv_id", "turn", "text", F.timestamp_seconds(F.lit(1_000_000_000) + F.col("turn") * 60).alias("at"))
    folder, out, checkpoint = (working_folder(spark) for _ in range(3))
    for part in range(3):
        turns.where((F.col("turn") * 7 + F.col("conv_id")) % 3 == part).write.mode("append").parquet(folder)
        streams.corrections_to_table(spark, folder, checkpoint, out)
    return streams.newest_revisions(spark, out)


_QUERIES = [
    sentence_window, topk_cosine, topk_index, index_upkeep, index_stream, dual_retrieval_merge, rerank_batches, retrieval_answer, chat_answers, chat_stream, ordered_sources, source_labels, label_file_name,
    cited_answers, paired_sources, latest_rules, noise_filter, inherited_rules, apologies, prompt_fill,
    history_last3, last_result, appended_results, last_three, intent_route, keyword_route, clarify_needed, query_expansion, reply_json, response_decode, page_concat, page_carry, page_fold, message_log,
    link_resolve, link_first_writer, link_filter, blacklist, link_names, link_tally, stored_downloads, committed_files, fetch_pages, anti_existing, url_quote, text_clean,
    text_lines, page_titles, image_base64, density_gate, density_semi, parse_files, table_cells, has_tables, loadable_files, ingest_routes, transcript_cache, index_swap, index_freshness,
    span_expand, span_expand_sql, html_links_sql, html_timetable, course_cells, pivot_fixed_domain, grid_fill, keyed_accumulate, chunk3, parse_lists, tagged_replies, latest_mtime,
    history_stream, history_corrections,
]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_SENTENCES = f"""
SELECT doc_id, sent, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord
FROM (SELECT doc_id, {_STRIP % 'unnest(parts)'} AS sent, unnest(range(len(parts))) AS i
      FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '([。！？])', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM documents))
WHERE sent <> ''
"""


def _top(where: str, embeddings: str = "embeddings") -> str:
    return f"""SELECT q.vec_id AS query_id, n.vec_id AS node_id, list_cosine_similarity(CAST(n.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(n.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, n.vec_id) AS pos
    FROM {embeddings} n CROSS JOIN {embeddings} q WHERE {where} QUALIFY pos <= 15"""


_AROUND_LABELS = "(SELECT vec_id, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * CAST(0.1 AS DOUBLE) + CASE WHEN i - 1 = label THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS embedding FROM embeddings)"
_MERGED = f"""
SELECT query_id, node_id, arg_max(score, place) AS score, row_number() OVER (PARTITION BY query_id ORDER BY min(place)) AS pos
FROM (SELECT query_id - query_id % 20 AS query_id, node_id, score, pos + 1000 * (query_id % 20) AS place FROM ({_top('q.vec_id % 20 IN (0, 1)')})) GROUP BY query_id, node_id
"""
_WORDS = "list_distinct(list_filter(string_split_regex(lower(%s), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))"
_LABEL = "CASE WHEN doc_id % 10 <> 9 THEN source ELSE '未知文件' END || CASE WHEN doc_id % 2 = 0 THEN ' (第 ' || (doc_id % 5) || ' 頁)' ELSE '' END"
_LINKS = """
SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href,
       unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS raw,
       unnest(range(len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)))) AS ord FROM pages
"""
_TEXT = "replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_SAFE = "regexp_replace(%s, '[\\\\/*?:\"<>|\\n\\r\\t]', '', 'g')"
_BARE = "regexp_replace(name, '^[0-9]+[.、\\s]*', '')"
_PERIOD_ROWS = ", ".join(f"({i}, '{p}', '{t}', {str(p in G.OPTIONAL).lower()})" for i, (p, t) in enumerate(G.PERIODS))
_DAY_CASE = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN 'd{i}'" for i in range(6)) + " END"
_DERIVED = f"SELECT page_id, ord, {_HREF} AS href, {_NAME} AS name, {_TXT} AS txt, {_ROW} AS tr_text FROM (SELECT page_id, ord, href, {_STRIP % _TEXT} AS txt FROM ({_LINKS}))"
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP % 'x'}), lambda x: x <> '')"
_FIRST = _STRIP % f"string_split({_STRIP % '%s'}, chr(10))[1]"
_FILES = "SELECT user_id, event_type AS name, epoch_us(ts) / 1e6 AS mtime FROM events"
_REPLIES = "SELECT conv_id, arg_max(text, turn) AS said, arg_max(role, turn) AS agent, list_sort(list(DISTINCT role)) AS sources FROM conversations GROUP BY conv_id"
_DEPT, _DEGREE = "(\\p{L}{2}(?:系|所))", "(學士|碩士|博士|大學部)"


_SPANS = """WITH h AS (SELECT user_id, h, row_number() OVER (PARTITION BY user_id ORDER BY h) - 1 AS r FROM (SELECT DISTINCT user_id, hour(ts) AS h FROM events))
SELECT user_id AS table_id, r AS row, (1 - user_id % 2) + e - w + k AS col, event_type AS text
FROM (SELECT user_id, r, event_type, 1 + event_id % 3 AS w, sum(1 + event_id % 3) OVER (PARTITION BY user_id, r ORDER BY event_id)::BIGINT AS e FROM events JOIN h USING (user_id) WHERE hour(ts) = h), unnest([0, 1, 2]) AS u(k) WHERE k < w
UNION ALL SELECT user_id, r + k, 0, 'from ' || h FROM h, unnest([0, 1]) AS u(k) WHERE user_id % 2 = 0 AND r % 2 = 0"""
_COUNTS = "[" + ", ".join(f"CAST(length(%s) - length(replace(%s, '{c}', '')) AS DOUBLE)" for c in _ALPHABET) + "]"
#: Every step of the answering plan: questions, both searches, merge, rerank, windows, rules, answers.
_CHAT = f"""
WITH s AS MATERIALIZED (SELECT doc_id * {A.SENTENCES} + ord AS node_id, sent, string_agg(sent, ' ') OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS w, file FROM ({_SENTENCES.replace("FROM documents", f"FROM (SELECT doc_id, {_RULED} AS text FROM documents)")}) JOIN (SELECT doc_id, {_TO_FILE} AS file FROM documents) USING (doc_id)),
v AS MATERIALIZED (SELECT node_id, {_COUNTS.replace("%s", "low")} AS v FROM (SELECT node_id, lower(sent) AS low FROM s) WHERE regexp_matches(low, '[a-z]')),
t AS (SELECT conv_id, turn, {_REQUEST} AS x FROM conversations WHERE role = 'user'),
b AS (SELECT *, nullif(regexp_extract(x, '{_DEPT}', 1), '') AS dept, nullif(regexp_extract(x, '{_DEGREE}', 1), '') AS deg, regexp_replace(regexp_replace(x, '{_DEPT}', '', 'g'), '{_DEGREE}|那|呢|的|班', '', 'g') AS bare FROM t),
h AS (SELECT conv_id, turn, x, last_value(dept IGNORE NULLS) OVER w AS department, last_value(deg IGNORE NULLS) OVER w AS degree, last_value(CASE WHEN length({_STRIP % 'bare'}) > 1 THEN bare END IGNORE NULLS) OVER w AS target,
  bool_or(regexp_matches(x, '系|所|學士|碩士|博士|大學部')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS narrow
 FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT *, CASE department {" ".join(f"WHEN '{d}' THEN '{c}'" for d, c in _COLLEGES)} END AS college, CASE WHEN intent = 'ACTION' THEN 'Action Agent' WHEN intent = 'CLARIFY' AND NOT narrow THEN 'Clarification Agent' ELSE 'Academic Agent' END AS agent FROM (SELECT *, {_INTENT.format("x")} AS intent FROM h)),
e AS (SELECT *, array_to_string(list_filter([x, array_to_string(list_filter([{_STRIP % 'target'}, department, college, coalesce(degree, '{C.GENERAL}')], lambda p: p IS NOT NULL AND p <> ''), ' ')], lambda p: p IS NOT NULL), ' ') AS wide FROM r),
q AS MATERIALIZED (SELECT conv_id, turn, k, {_COUNTS.replace("%s", "low")} AS v FROM (SELECT conv_id, turn, 0 AS k, lower(x) AS low FROM e WHERE agent = 'Academic Agent' UNION ALL SELECT conv_id, turn, 1, lower(wide) FROM e WHERE agent = 'Academic Agent') WHERE regexp_matches(low, '[a-z]')),
f AS (SELECT conv_id, turn, k, node_id, row_number() OVER (PARTITION BY conv_id, turn, k ORDER BY c DESC, node_id) AS pos FROM (SELECT conv_id, turn, k, node_id, round(list_cosine_similarity(v.v, q.v), {R.DIGITS}) AS c FROM q, v) QUALIFY pos <= {R.TOP}),
m AS (SELECT conv_id, turn, node_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY min(pos + 1000 * k)) AS pos FROM f GROUP BY conv_id, turn, node_id),
g AS (SELECT m.*, s.w, s.file, e.department, e.college, row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(len(list_intersect({_WORDS % 'e.x'}, {_WORDS % 's.sent'})) / nullif(len({_WORDS % 'e.x'}), 0), 0) DESC, pos) AS rank FROM m JOIN s USING (node_id) JOIN e USING (conv_id, turn) QUALIFY rank <= {R.KEPT}),
y AS (SELECT *, trim(regexp_replace(file, '[0-9]{{2,4}}\\s*學年度?', '', 'g')) AS topic, coalesce(TRY_CAST(nullif(regexp_extract(file || ' ' || w, '([0-9]{{2,4}})\\s*學年', 1), '') AS INT), -1) AS year FROM g WHERE NOT regexp_matches(w, '{"|".join(R.NOISE)}')),
l AS (SELECT *, CASE WHEN contains(w, department) THEN 0 WHEN contains(w, college) THEN 1 WHEN contains(w, '全校') THEN 2 END AS level FROM y QUALIFY year = max(year) OVER (PARTITION BY conv_id, turn, topic)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY regexp_matches(file, '{"|".join(R.FAQ)}'), rank) AS place FROM (SELECT * FROM l QUALIFY level IS NULL OR level = min(level) OVER (PARTITION BY conv_id, turn))),
a AS (SELECT conv_id, turn, string_agg(w, chr(10) ORDER BY place) AS answer FROM p GROUP BY ALL),
o AS (SELECT conv_id, turn, string_agg(file, ';' ORDER BY first) AS sources FROM (SELECT conv_id, turn, file, min(place) AS first FROM p GROUP BY ALL) GROUP BY ALL)
SELECT conv_id AS thread_id, turn, agent AS next_agent, md5(coalesce(answer, CASE agent WHEN 'Academic Agent' THEN '{R.NOT_FOUND}' WHEN 'Action Agent' THEN '{A.NO_ACTION}' ELSE '{A.CLARIFY}' END)) AS answer, coalesce(sources, '') AS sources
FROM e LEFT JOIN a USING (conv_id, turn) LEFT JOIN o USING (conv_id, turn)"""


def oracle_sql() -> dict[str, str]:
    return {
        "cited_answers": f"""WITH h AS (SELECT query_id, pos, doc_id, text, {_LABEL} AS label FROM (SELECT query_id, pos, node_id % (SELECT count(*) FROM documents) AS doc_id FROM ({_top('q.vec_id % 20 = 0')})) JOIN documents USING (doc_id)),
a AS (SELECT query_id, CASE WHEN query_id % 40 = 0 THEN '{R.NOT_FOUND}' ELSE string_agg(text, chr(10) ORDER BY pos) END AS answer FROM h GROUP BY query_id),
l AS (SELECT query_id, string_agg(label, ';' ORDER BY p) AS sources FROM (SELECT query_id, label, min(pos) AS p FROM h GROUP BY query_id, label) GROUP BY query_id)
SELECT query_id, md5(answer) AS answer, sources FROM a JOIN l USING (query_id)""",
        "page_fold": "SELECT conv_id, turn, coalesce(right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 3), '') || text AS text FROM conversations",
        "message_log": "SELECT conv_id, turn, role, text FROM conversations",
        "fetch_pages": "SELECT page_id, CAST(CASE right(url, 1) WHEN '3' THEN 0 WHEN '7' THEN 404 ELSE 200 END AS BIGINT) AS status, CASE WHEN right(url, 1) = '3' THEN 'OSError: no route' END AS error, CASE WHEN right(url, 1) NOT IN ('3', '7') THEN upper(url) END AS body FROM pages",
        "parse_files": """SELECT path, page, md5(x) AS text, error FROM (SELECT 'd/' || doc_id || '.pdf' AS path, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS page, unnest(string_split(text, chr(10))) AS x, CAST(NULL AS VARCHAR) AS error FROM documents WHERE doc_id % 10 <> 7)
UNION ALL SELECT 'd/' || doc_id || '.pdf', -1, NULL, 'ValueError: broken' FROM documents WHERE doc_id % 10 = 7""",
        "table_cells": """WITH l AS (SELECT 'd/' || doc_id || '.pdf' AS path, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS r, unnest(string_split(text, chr(10))) AS x FROM documents WHERE doc_id % 10 <> 7)
SELECT path, r, c, md5(y) AS text, error FROM (SELECT path, r, CAST(unnest(range(len(string_split(x, '|')))) AS BIGINT) AS c, unnest(string_split(x, '|')) AS y, CAST(NULL AS VARCHAR) AS error FROM l)
UNION ALL SELECT 'd/' || doc_id || '.pdf', -1, -1, NULL, 'ValueError: broken' FROM documents WHERE doc_id % 10 = 7""",
        "has_tables": f"""SELECT 'd/' || doc_id || '.pdf' AS path, doc_id % 10 = 7 OR coalesce(count(*) FILTER (c <> '') >= 4 AND sum(length(c)) / count(*) FILTER (c <> '') < 35, false) AS has_table
FROM (SELECT doc_id, {_STRIP % "unnest(string_split_regex(text, '[|\n]'))"} AS c FROM documents) GROUP BY doc_id""",
        "loadable_files": f"SELECT doc_id, name AS file_name, CASE WHEN ends_with(name, '.pdf') THEN 'pdf' ELSE 'docx' END AS kind FROM (SELECT doc_id, {_FILE} AS name FROM documents WHERE doc_id % 10 <> 4 AND text <> '') WHERE NOT starts_with(name, '.') AND NOT starts_with(name, '~$') AND regexp_matches(name, '\\.(pdf|docx)$')",
        "dual_retrieval_merge": f"SELECT query_id, node_id, round(score, 6) AS score, pos FROM ({_MERGED})",
        "rerank_batches": f"SELECT query_id, node_id, CAST(floor((pos - 1) / 5) AS BIGINT) AS batch FROM ({_top('q.vec_id % 20 = 0')})",
        "retrieval_answer": f"""
WITH n AS (SELECT count(*) AS n FROM documents),
hits AS (SELECT query_id, node_id, pos, node_id % n AS doc_id, query_id % n AS asked FROM ({_MERGED}), n),
scored AS (SELECT h.*, d.source, d.text, len(list_intersect({_WORDS % 'q.text'}, {_WORDS % 'd.text'})) / len({_WORDS % 'q.text'}) AS relevance
  FROM hits h JOIN documents d USING (doc_id) JOIN documents q ON q.doc_id = h.asked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, pos) AS rank FROM scored QUALIFY rank <= 8),
windows AS (SELECT doc_id, ord, count(*) OVER (PARTITION BY doc_id) AS sents, string_agg(sent, ' ') OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS w FROM ({_SENTENCES}))
SELECT query_id, rank, node_id, r.doc_id, round(relevance, 6) AS relevance, source AS label, coalesce(w, text) AS "window" FROM ranked r LEFT JOIN windows w ON r.doc_id = w.doc_id AND w.ord = node_id % sents""",
        "paired_sources": f"SELECT query_id, node_id, node_id % 3 <> 0 AS basis, row_number() OVER (PARTITION BY query_id ORDER BY node_id % 3 = 0, pos) AS place FROM ({_MERGED})",
        "latest_rules": "SELECT source, md5(t) AS text FROM (SELECT source, CASE WHEN doc_id % 4 = 0 THEN text ELSE (100 + doc_id % 17) || ' 學年度 ' || text END AS t, CASE WHEN doc_id % 4 <> 0 THEN 100 + doc_id % 17 END AS y FROM documents) QUALIFY row_number() OVER (PARTITION BY source ORDER BY y DESC NULLS LAST, t) = 1",
        "noise_filter": "SELECT doc_id, md5(text) AS text FROM documents WHERE doc_id % 5 <> 0",
        "inherited_rules": """WITH c AS (SELECT 'c' || c_custkey AS unit, 'n' || c_nationkey AS above, c_mktsegment AS topic, c_acctbal, c_nationkey FROM customer),
o AS (SELECT DISTINCT above, topic FROM c WHERE c_nationkey % 3 = 0)
SELECT unit, c.topic, CASE WHEN c_acctbal > 5000 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) WHEN o.above IS NOT NULL THEN 'as in ' || c.above WHEN c.topic <> 'MACHINERY' THEN 'general' END AS rule,
 CASE WHEN c_acctbal > 5000 THEN unit WHEN o.above IS NOT NULL THEN c.above WHEN c.topic <> 'MACHINERY' THEN '*' END AS source_unit FROM c LEFT JOIN o ON o.above = c.above AND o.topic = c.topic""",
        "apologies": f"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '{R.FAILED}' ELSE text END AS answer, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS sources FROM conversations",
        "prompt_fill": "SELECT doc_id, md5('From ' || source || ':' || chr(10) || '{lang}' || text || chr(10) || '(' || source || ', ' || lang || ')') AS prompt FROM documents",
        "label_file_name": f"SELECT doc_id, split_part({_LABEL}, ' (', 1) AS file_name FROM documents",
        "intent_route": f"""SELECT conv_id, turn, agent AS next_agent, CASE agent WHEN 'Action Agent' THEN 'action_node' WHEN 'Clarification Agent' THEN 'clarification_node' WHEN 'Academic Agent' THEN 'academic_node' ELSE 'fallback_node' END AS node
FROM (SELECT conv_id, turn, CASE WHEN contains(said, 'ACTION') THEN 'Action Agent' WHEN contains(said, 'CLARIFY') THEN 'Clarification Agent' WHEN contains(said, 'ACADEMIC') THEN 'Academic Agent' ELSE 'Fallback Agent' END AS agent
 FROM (SELECT conv_id, turn, upper({_SAID}) AS said FROM conversations))""",
        "keyword_route": f"""SELECT conv_id, turn, CASE WHEN contains(t, '幫我') AND NOT asks THEN 'Action Agent' WHEN length({_STRIP % 't'}) <= 4 THEN 'Clarification Agent' WHEN asks THEN 'Academic Agent' ELSE 'Fallback Agent' END AS next_agent
FROM (SELECT *, regexp_matches(t, '多少錢|要錢|費用|補助|怎麼|規定|期限|門檻|\\?|？') AS asks FROM (SELECT conv_id, turn, {_ASKED} AS t FROM conversations))""",
        "clarify_needed": f"SELECT conv_id, turn, NOT bool_or(regexp_matches({_NARROWED}, '系|所|學士|碩士|博士|大學部')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS clarify FROM conversations",
        "query_expansion": f"""WITH t AS (SELECT conv_id, turn, {_FOLLOWED} AS x FROM conversations),
b AS (SELECT *, nullif(regexp_extract(x, '{_DEPT}', 1), '') AS dept, nullif(regexp_extract(x, '{_DEGREE}', 1), '') AS deg, regexp_replace(regexp_replace(x, '{_DEPT}', '', 'g'), '{_DEGREE}|那|呢|的|班', '', 'g') AS bare FROM t),
h AS (SELECT conv_id, turn, last_value(dept IGNORE NULLS) OVER w AS department, last_value(deg IGNORE NULLS) OVER w AS degree, last_value(CASE WHEN length({_STRIP % 'bare'}) > 1 THEN bare END IGNORE NULLS) OVER w AS target
 FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, turn, department, degree, array_to_string(list_filter([{_STRIP % 'target'}, department, CASE department WHEN '企管系' THEN '管理學院' WHEN '資工系' THEN '資電學院' END, coalesce(degree, '全校通用 大學部')], lambda p: p IS NOT NULL AND p <> ''), ' ') AS expanded FROM h""",
        "reply_json": f"SELECT conv_id, CAST(json_object('status', 'success', 'response', json_array(said), 'sources', to_json(sources), 'debug_info', json_object('current_step', 'completed', 'executed_agent', agent)) AS VARCHAR) AS reply FROM ({_REPLIES})",
        "response_decode": f"SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN '{C.NO_RESULT}' ELSE said END AS answer, CASE WHEN conv_id % 5 = 0 THEN '' ELSE array_to_string(sources, ';') END AS sources FROM ({_REPLIES})",
        "last_three": "SELECT conv_id, string_agg(text, chr(1) ORDER BY turn) AS texts FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) GROUP BY conv_id",
        "link_filter": f"""SELECT page_id, ord, href, CASE WHEN lower(href) LIKE '%.docx%' OR lower(name) LIKE '%.docx%' THEN '.docx' WHEN lower(href) LIKE '%.doc%' OR lower(name) LIKE '%.doc%' THEN '.doc' ELSE '.pdf' END AS ext
FROM ({_DERIVED}) WHERE href <> '' AND href <> '#' AND href NOT LIKE '%javascript%' AND lower(href) NOT LIKE '%.odt%' AND regexp_matches(lower(href), 'download|file|\\.pdf|\\.doc')""",
        "blacklist": f"SELECT page_id, ord, regexp_replace({_SAFE % _BARE}, '(?i)\\.pdf$|\\.docx?$', '') AS name FROM ({_DERIVED}) WHERE name NOT LIKE '%測試用檔案%' AND name NOT LIKE '%無效文件%' AND name <> '檔案下載'",
        "link_names": f"""WITH l AS (SELECT page_id, ord, {_SAFE % (_FIRST % 'txt')} AS name, {_SAFE % (_FIRST % 'tr_text')} AS r FROM ({_DERIVED}))
SELECT page_id, ord, CASE WHEN length(r) > 3 AND (length(name) <= 3 OR lower(name) IN ({", ".join(f"'{g}'" for g in L.GENERIC)}) OR lower({_STRIP % _BARE}) IN ({", ".join(f"'{g}'" for g in L.GENERIC)})) THEN r ELSE name END AS name FROM l""",
        "link_tally": f"""WITH l AS (SELECT page_id, ord, {_SAFE % (_STRIP % _TEXT)} AS name FROM ({_LINKS})), f AS (SELECT page_id, count(*) AS files FROM (SELECT * FROM l WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY page_id, ord) = 1) GROUP BY page_id)
SELECT page_id, count(*) AS links, coalesce(max(files), 0) AS files FROM l LEFT JOIN f USING (page_id) GROUP BY page_id""",
        "stored_downloads": f"""WITH l AS (SELECT page_id, ord, href, {_SAFE % (_STRIP % _TEXT)} AS file_name FROM ({_LINKS})), f AS (SELECT * FROM l WHERE file_name <> '' QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY page_id, ord) = 1)
SELECT file_name, md5(href) AS content, CAST((SELECT count(*) FROM f) AS INTEGER) AS stored FROM f""",
        "text_lines": f"SELECT doc_id, CAST(len({_LINES}) AS BIGINT) AS n, md5(array_to_string({_LINES}, '|')) AS lines, md5({_FIRST % 'text'}) AS first FROM documents",
        "page_titles": f"SELECT doc_id, CASE WHEN length(t) > 2 THEN t END AS title FROM (SELECT doc_id, {_SAFE % f'left(coalesce(({_LINES})[1], {chr(39) * 2}), 50)'} AS t FROM documents)",
        "image_base64": "SELECT doc_id, md5('data:image/png;base64,' || to_base64(encode(text))) AS url FROM documents",
        "density_gate": f"SELECT doc_id, doc_id % 97 = 0 OR coalesce(n >= 4 AND s / n < 35, false) AS has_table FROM (SELECT doc_id, count(*) FILTER (c <> '') AS n, sum(length(c)) AS s FROM (SELECT doc_id, {_STRIP % 'unnest(string_split(text, chr(124)))'} AS c FROM documents) GROUP BY doc_id)",
        "density_semi": f"SELECT source, bool_or(n >= 4 AND s / n < 35) AS has_table FROM (SELECT source, doc_id, count(*) FILTER (c <> '') AS n, sum(length(c)) AS s FROM (SELECT source, doc_id, {_STRIP % 'unnest(string_split(text, chr(10)))'} AS c FROM documents) GROUP BY source, doc_id) GROUP BY source",
        "ingest_routes": f"""WITH g AS (SELECT doc_id, count(*) FILTER (c <> '') >= 4 AND sum(length(c)) / count(*) FILTER (c <> '') < 35 AS dense FROM (SELECT doc_id, {_STRIP % 'unnest(string_split(text, chr(124)))'} AS c FROM documents) GROUP BY doc_id)
SELECT doc_id || CASE WHEN doc_id % 4 = 0 THEN '.docx' ELSE '.pdf' END AS file_name, CASE WHEN doc_id % 4 = 0 THEN 'docx' WHEN doc_id % 5 = 0 THEN 'cache' WHEN doc_id % 7 = 0 OR dense THEN 'ocr' ELSE 'plain' END AS route,
 md5(CASE WHEN doc_id % 4 = 0 THEN text WHEN doc_id % 5 = 0 THEN 'cached ' || text WHEN doc_id % 7 = 0 OR dense THEN array_to_string(list_reverse(regexp_extract_all(text, '(?s).')), '') ELSE text END) AS text FROM documents JOIN g USING (doc_id)""",
        "transcript_cache": "SELECT CAST(doc_id AS VARCHAR) AS path, md5(CASE WHEN doc_id % 3 = 0 THEN text || ' again' ELSE text END) AS text FROM documents",
        "index_swap": "SELECT vec_id AS node_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(2 AS DOUBLE) AS saved FROM embeddings",
        "index_freshness": f"SELECT user_id, latest, saved, coalesce(latest > saved, true) AS rebuild FROM (SELECT user_id, coalesce(max(mtime) FILTER (name <> 'view'), 0) AS latest, CASE WHEN user_id % 3 = 0 THEN max(mtime) FILTER (name = 'click') END AS saved FROM ({_FILES}) GROUP BY user_id)",
        "span_expand": _SPANS,
        "span_expand_sql": _SPANS,
        "html_timetable": """WITH c AS (SELECT user_id, hour(ts) AS h, event_id % 7 AS d, string_agg(event_type || '#' || event_id, chr(10) ORDER BY event_id) AS raw FROM events GROUP BY 1, 2, 3),
r AS (SELECT user_id, h, row_number() OVER (PARTITION BY user_id ORDER BY h) AS row FROM (SELECT DISTINCT user_id, h FROM c))
SELECT user_id AS table_id, row, 3 + d AS col, CASE WHEN d = 3 THEN '未知星期(6)' ELSE 'D' || d END AS day, 'P' || h AS period, lpad(CAST(h AS VARCHAR), 2, '0') || ':00 ' || lpad(CAST(h AS VARCHAR), 2, '0') || ':50' AS time, raw AS raw_content, replace(raw, chr(10), ',') AS details FROM c JOIN r USING (user_id, h)""",
        "course_cells": """WITH i AS (SELECT user_id, hour(ts) AS hour, event_id * 2 AS o, '&lt;' || event_type AS x FROM events UNION ALL SELECT user_id, hour(ts), event_id * 2 + 1, CAST(event_id AS VARCHAR) FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, hour ORDER BY o) - 1 AS k FROM i),
b AS (SELECT user_id, hour, k // 3 AS c, count(*) AS s, max(x) FILTER (k % 3 = 0) AS a, max(x) FILTER (k % 3 = 1) AS b, max(x) FILTER (k % 3 = 2) AS d FROM n GROUP BY 1, 2, 3)
SELECT user_id, hour, string_agg('<div class=''course-block''>' || CASE s WHEN 3 THEN '<div class=''course-code''>' || a || '</div><div class=''course-title''>' || b || '</div><div class=''course-location''>' || d || '</div>'
 WHEN 2 THEN '<div class=''course-title''>' || a || '</div><div class=''course-location''>' || b || '</div>' ELSE '<div class=''course-title''>' || a || '</div>' END || '</div>', '<div class=''course-divider''></div>' ORDER BY c) AS cell FROM b GROUP BY user_id, hour""",
        "grid_fill": f"""WITH c AS (SELECT user_id, hour(ts) AS period_ord, {_DAY_CASE} AS day, string_agg(event_id || ',' || event_type, ',' ORDER BY event_id) AS details FROM events WHERE event_id % 7 < 6 GROUP BY 1, 2, 3)
SELECT user_id, period, time, {", ".join(f"coalesce(max(details) FILTER (day = 'd{i}'), '') AS d{i}" for i in range(6))}
FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (VALUES {_PERIOD_ROWS}) AS p(period_ord, period, time, optional) LEFT JOIN c USING (user_id, period_ord) GROUP BY user_id, period, time, optional HAVING count(day) > 0 OR NOT optional""",
        "parse_lists": f"""SELECT event_id, CASE WHEN j IS NULL THEN 'text ' || event_type ELSE json_extract_string(j, '$[0].day') END AS day, array_to_string(CAST(json_extract(j, '$[0].details') AS VARCHAR[]), ',') AS details
FROM (SELECT event_id, event_type, CASE WHEN starts_with(said, '[') THEN CAST(replace(replace(replace(replace(said, '''', '"'), 'None', 'null'), '[[', '['), ']]', ']') AS JSON) END AS j
 FROM (SELECT event_id, event_type, {_STRIP % _LISTED} AS said FROM events))""",
        "latest_mtime": f"SELECT max(mtime) AS latest FROM ({_FILES}) WHERE name <> 'view'",
        "sentence_window": f"SELECT doc_id, ord, string_agg(sent, ' ') OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS \"window\" FROM ({_SENTENCES})",
        "topk_cosine": f"SELECT query_id, node_id, round(score, 6) AS score, pos FROM ({_top('q.vec_id % 20 = 0')})",
        "chat_answers": _CHAT,
        "chat_stream": _CHAT,
        "topk_index": f"SELECT query_id, node_id, round(score, 6) AS score, pos FROM ({_top('q.vec_id % 20 = 0', _AROUND_LABELS)})",
        "index_upkeep": "SELECT doc_id, md5(CASE WHEN doc_id % 5 = 1 THEN text || ' at last' ELSE text END) AS text FROM documents WHERE doc_id % 11 <> 1",
        "index_stream": "SELECT doc_id, md5(CASE WHEN doc_id % 5 = 1 THEN text || ' again' ELSE text END) AS text FROM documents WHERE doc_id % 7 <> 1",
        "ordered_sources": f"SELECT lang, string_agg(label, ';' ORDER BY p) AS sources FROM (SELECT lang, label, min(doc_id) AS p FROM (SELECT lang, doc_id, {_LABEL} AS label FROM documents) GROUP BY lang, label) GROUP BY lang",
        "source_labels": f"SELECT doc_id, {_LABEL} AS label FROM documents",
        "history_last3": "SELECT conv_id, turn, string_agg(text, ' -> ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS history FROM conversations WHERE role = 'user'",
        "history_corrections": "SELECT conv_id, turn, string_agg(text, ' -> ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS history FROM conversations WHERE role = 'user'",
        "history_stream": "SELECT conv_id, turn, string_agg(text, ' -> ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS history FROM conversations WHERE role = 'user'",
        "last_result": "SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id",
        "appended_results": "SELECT conv_id, string_agg(text, chr(1) ORDER BY turn) AS texts FROM conversations GROUP BY conv_id",
        "page_concat": "SELECT conv_id, string_agg(coalesce(text, '') || chr(10) || chr(10), '' ORDER BY turn) AS text, string_agg(chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS ocr_text FROM conversations GROUP BY conv_id",
        "page_carry": "SELECT conv_id, turn, coalesce(right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 400), '') AS carry FROM conversations",
        "committed_files": f"""SELECT name AS file_name, octet_length(encode(href)) AS length, md5(href) AS content, CAST(NULL AS VARCHAR) AS error
FROM (SELECT {_SAFE % (_FIRST.replace('%s', _TEXT))} AS name, href, page_id, ord FROM ({_LINKS})) WHERE name > 'B' AND octet_length(encode(name)) < 200 QUALIFY row_number() OVER (PARTITION BY name ORDER BY page_id, ord) = 1 AND octet_length(encode(href)) > 5""",
        "tagged_replies": f"""SELECT event_id, CASE WHEN k IN (0, 5) THEN 'text' WHEN k IN (1, 2) THEN 'nothing' ELSE 'courses' END AS kind, CASE WHEN k IN (0, 5) THEN said END AS text, CASE WHEN k IN (3, 4) THEN 1 WHEN k = 6 THEN 2 ELSE 0 END::BIGINT AS n,
 CASE WHEN k IN (3, 4, 6) THEN event_type END AS day, CASE k WHEN 3 THEN user_id || ',x' WHEN 4 THEN CAST(user_id AS VARCHAR) END AS details FROM (SELECT event_id, event_type, user_id, event_id % 7 AS k, {_MIXED} AS said FROM events)""",
        "html_links_sql": f"SELECT page_id, ord, href, {_TEXT} AS txt, 'No. ' || ord || {_TEXT} AS tr_text FROM ({_LINKS})",
        "link_resolve": f"SELECT page_id, ord, regexp_extract(url, '^[a-z]+://[^/]*') || href AS full_url FROM ({_LINKS})",
        "link_first_writer": f"SELECT name, page_id, ord FROM (SELECT {_SAFE % (_STRIP % _TEXT)} AS name, page_id, ord FROM ({_LINKS})) WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY page_id, ord) = 1",
        "anti_existing": f"WITH l AS (SELECT page_id, {_STRIP % _TEXT} AS file_name FROM ({_LINKS})) SELECT page_id, count(*) AS n FROM l WHERE file_name NOT IN (SELECT file_name FROM l WHERE page_id % 3 = 0) GROUP BY page_id",
        "url_quote": "SELECT doc_id, md5(replace(url_encode(text), '%2F', '/')) AS quoted FROM documents",
        "text_clean": f"SELECT doc_id, md5({_STRIP % _clean_sql()}) AS cleaned FROM documents",
        "pivot_fixed_domain": "SELECT hour(ts) AS hour, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in EVENT_TYPES) + " FROM events GROUP BY hour(ts)",
        "keyed_accumulate": "SELECT user_id, hour(ts) AS hour, string_agg(event_type || ',' || event_id, ',' ORDER BY event_id) AS details FROM events GROUP BY user_id, hour(ts)",
        "chunk3": "SELECT user_id, n, string_agg(event_type, '/' ORDER BY event_id) AS chunk FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 3) AS BIGINT) AS n FROM events) GROUP BY user_id, n",
    }


def _clean_sql() -> str:
    out = "'```markdown' || chr(10) || 'here is the file' || chr(10) || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) || 'Hope this helps! z'"
    for flags, pattern in (("m", T.FENCE_OPEN), ("m", T.FENCE_LINE), ("im", T.LEAD_IN), ("im", T.CLOSING)):
        out = f"regexp_replace({out}, '(?{flags}){pattern.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return out
