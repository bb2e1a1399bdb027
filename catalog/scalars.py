"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import ORACLE, query
from catalog.fixtures import ANALYSES, analyses, events, table, texts, ts
from corpuscle.functions import answers as A
from corpuscle.functions import identity as I
from corpuscle.functions import measures as M
from corpuscle.functions import questions as Q
from corpuscle.functions import text as X
from corpuscle.functions import vocab as V

NORM = r"""lower(trim(regexp_replace(regexp_replace(regexp_replace(
  translate({c}, '“”‘’–—⁰¹²³⁴⁵⁶⁷⁸⁹', '""''''--0123456789'),
  '(\d),(\d{{1,2}})([^\p{{L}}\p{{N}}_]|$)', '\1.\2\3', 'g'), '(\d),(\d{{1,2}})([^\p{{L}}\p{{N}}_]|$)', '\1.\2\3', 'g'), '\s+', ' ', 'g')))"""


def norm(c: str) -> str:
    return NORM.format(c=c)


def quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def counted(text: str, words) -> str:
    """SQL: how many of the words occur in the text."""
    return f"len(list_filter({quoted(words)}, lambda w: contains({text}, w)))"


def docs(spark, d):
    return texts(spark, d)


def html(spark, d):
    return texts(spark, d, "pages")


# --- lines -------------------------------------------------------------------------------------

LINES = """doc_text_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
  more AS (SELECT doc_id, line FROM doc_text_lines UNION ALL
    SELECT page_id + 1000000, unnest(string_split(replace(html, '<', chr(10) || '<'), chr(10))) FROM pages)"""


def lines(spark, d):
    a = docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    b = html(spark, d).select(
        (F.col("page_id") + 1000000).alias("doc_id"), F.explode(F.split(F.replace("html", F.lit("<"), F.lit("\n<")), "\n")).alias("line")
    )
    return a.unionByName(b)


_SQL_SIGNAL = " OR ".join(
    ["regexp_matches(s, '" + p.replace("'", "''") + "')" for p in (*V.SIGNAL_PATTERNS_STRIPPED, V.CAPITAL_THEN_DIGIT_PATTERN)]
    + ["regexp_matches(lower(s), '" + "|".join(V.SIGNAL_WORDS) + "')"]
)


@query("line_rules", rf"""WITH {LINES}, t AS (SELECT doc_id, line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM more),
    f AS (SELECT doc_id, line, regexp_matches(line, '^\s*\d+/\d+\s*$') AS page_number,
        regexp_matches(lower(s), '^(©|copyright|all rights reserved)') AS legal,
        (s <> '' AND ({_SQL_SIGNAL})) AS signal FROM t)
    SELECT doc_id, count(*) AS lines, count(*) FILTER (page_number) AS page_numbers, count(*) FILTER (legal) AS legal,
      count(*) FILTER (page_number OR legal) AS editorial, count(*) FILTER (signal) AS signals FROM f GROUP BY doc_id""")
def line_rules(spark, d):
    """Page-number, legal, editorial and signal rules on every line of texts and pages."""
    return lines(spark, d).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(X.is_page_number("line")).alias("page_numbers"),
        F.count_if(X.is_legal("line")).alias("legal"),
        F.count_if(X.is_editorial("line")).alias("editorial"),
        F.count_if(X.has_signal("line")).alias("signals"),
    )


@query("clean_text", r"""SELECT doc_id, CASE WHEN NOT regexp_matches(text, '\S') THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)),
      lambda l: regexp_matches(l, '\S') AND NOT regexp_matches(l, '^\s*\d+/\d+\s*$')
        AND NOT regexp_matches(lower(l), '^\s*(©|copyright|all rights reserved)')), chr(10)) END AS cleaned FROM documents""")
def clean_text(spark, d):
    return docs(spark, d).select("doc_id", X.clean_text("text").alias("cleaned"))


@query("garbled_text", r"""WITH t AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT page_id + 1000000, 0, html FROM pages)
    SELECT conv_id, turn,
      (length(text) < 50 OR (length(text) - length(replace(text, '?', '')))::DOUBLE / length(text) > 0.04) AS garbled,
      (length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 200 OR length(text) < 50
        OR (length(text) - length(replace(text, '?', '')))::DOUBLE / length(text) > 0.04) AS poor,
      round(length(regexp_replace(text, '\P{Nd}', '', 'g'))::DOUBLE / greatest(length(text), 1), 6) AS digit_density
    FROM t""")
def garbled_text(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", "text").unionByName(
        html(spark, d).select((F.col("page_id") + 1000000).alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.col("html").alias("text"))
    )
    return t.select(
        "conv_id", "turn", X.is_garbled("text").alias("garbled"), X.is_context_poor("text").alias("poor"),
        F.round(X.digit_density("text"), 6).alias("digit_density"),
    )


@query("normalize_text", f"SELECT page_id, {norm('html')} AS normalized FROM pages UNION ALL SELECT doc_id + 1000000, {norm('text')} FROM documents")
def normalize_text(spark, d):
    a = html(spark, d).select("page_id", F.col("html").alias("t"))
    b = docs(spark, d).select((F.col("doc_id") + 1000000).alias("page_id"), F.col("text").alias("t"))
    full = X.with_nfkc(a.unionByName(b), "t")
    return full.select("page_id", X.normalize_text("t").alias("normalized"))


_NUMS = r"list_filter(regexp_extract_all({n}, '\d+(?:[.,]\d+)?%?'), lambda x: contains(x, '.') OR contains(x, '%') OR length(regexp_replace(x, '\D', '', 'g')) >= 2)"


@query("extract_numbers", rf"""WITH n AS (SELECT page_id, {norm('html')} AS n FROM pages UNION ALL SELECT doc_id + 1000000, {norm('text')} FROM documents)
    SELECT page_id, array_to_string({_NUMS.format(n='n')}, '|') AS numbers FROM n""")
def extract_numbers(spark, d):
    a = html(spark, d).select("page_id", F.col("html").alias("t"))
    b = docs(spark, d).select((F.col("doc_id") + 1000000).alias("page_id"), F.col("text").alias("t"))
    return a.unionByName(b).select("page_id", F.array_join(X.extract_numbers("t"), "|").alias("numbers"))


@query("unsupported_numbers", rf"""WITH n AS (SELECT page_id, {norm('html')} AS a, {norm('text')} AS c FROM pages JOIN documents ON doc_id = page_id),
    u AS (SELECT page_id, c, unnest({_NUMS.format(n='a')}) AS num FROM n)
    SELECT page_id, count(DISTINCT num) FILTER (NOT contains(c, num)) AS unsupported,
      coalesce(array_to_string(list_sort(list(DISTINCT num) FILTER (NOT contains(c, num))), '|'), '') AS numbers
    FROM u GROUP BY page_id""")
def unsupported_numbers(spark, d):
    """Numbers of each web page that the document of the same number lacks."""
    j = html(spark, d).join(docs(spark, d), F.col("doc_id") == F.col("page_id"))
    n = A.unsupported_numbers("html", "text")
    return j.filter(F.size(X.extract_numbers("html")) > 0).select(
        "page_id", F.size(n).cast("bigint").alias("unsupported"), F.array_join(F.array_sort(n), "|").alias("numbers")
    )


@query("numbers_in_any_form", "SELECT doc_id, 0 AS unsupported FROM documents")
def numbers_in_any_form(spark, d):
    """Every document as an answer in full-width digits, checked against itself in plain ones."""
    rows = docs(spark, d).select("doc_id", "text", F.translate("text", "0123456789", "０１２３４５６７８９").alias("said"))
    return X.with_nfkc(rows, "said").select("doc_id", F.size(A.unsupported_numbers("said", "text")).alias("unsupported"))


# --- answers -----------------------------------------------------------------------------------

# The given texts hold no refusals: markers are appended by role, so that each rule fires.
SPOKEN = """spoken AS (SELECT conv_id, turn, role, CASE
    WHEN role = 'system' THEN text || ' Not available in the context. Does not provide information.'
    WHEN role = 'assistant' AND length(text) > 200 THEN text || ' não há dados'
    WHEN role = 'assistant' THEN 'I couldn''t find enough relevant information in the available documents to answer this question confidently. Feel free to ask something else related to the topics covered in the knowledge base.'
    ELSE text || ' SEM_RESPOSTA_NO_CONTEXTO' END AS answer FROM conversations)"""


def spoken(spark, d):
    c = table(spark, d, "conversations")
    return c.select(
        "conv_id", "turn", "role",
        F.when(F.col("role") == "system", F.concat("text", F.lit(" Not available in the context. Does not provide information.")))
        .when((F.col("role") == "assistant") & (F.length("text") > 200), F.concat("text", F.lit(" não há dados")))
        .when(F.col("role") == "assistant", F.lit(V.REFUSAL_MESSAGES["en"]))
        .otherwise(F.concat("text", F.lit(" " + V.NO_ANSWER_SENTINEL))).alias("answer"),
    )


_HITS = "list_sum(list_transform(" + quoted(V.SKELETON_MARKERS) + ", lambda m: (length(n) - length(replace(n, m, ''))) // length(m)))"


@query("answer_checks", f"""WITH {SPOKEN}, t AS (SELECT *, {norm('answer')} AS n FROM spoken), h AS (SELECT *, {_HITS} AS hits FROM t)
    SELECT conv_id, turn, (n <> '' AND (hits >= 2 OR (hits >= 1 AND length(n) < 300))) AS skeleton,
      (n = '' OR contains(n, 'i couldn''t find enough relevant information in the available documents')) AS refusal,
      contains(answer, 'SEM_RESPOSTA_NO_CONTEXTO') AS sentinel FROM h""")
def answer_checks(spark, d):
    return spoken(spark, d).select(
        "conv_id", "turn", A.is_skeleton("answer").alias("skeleton"), A.is_refusal("answer").alias("refusal"),
        A.has_sentinel("answer").alias("sentinel"),
    )


_TOK = "list_filter(regexp_extract_all({n}, '" + V.TOKEN_PATTERN + r"'), lambda t: regexp_matches(t, '\d') OR length(t) > 4)"


@query("significant_tokens", f"""SELECT page_id, array_to_string({_TOK.format(n=norm('html'))}, '|') AS tokens FROM pages""")
def significant_tokens(spark, d):
    return html(spark, d).select("page_id", F.array_join(A.significant_tokens("html"), "|").alias("tokens"))


@query("mention_coverage", f"""WITH p AS (SELECT doc_id, unnest(string_split(text, '. ')) AS point FROM documents),
    e AS (SELECT q.doc_id, q.point, {norm('a.text')} AS answer, {norm('q.point')} AS np
      FROM p q JOIN documents a ON a.doc_id = q.doc_id + 1),
    t AS (SELECT doc_id, answer, {_TOK.format(n='np')} AS toks FROM e),
    m AS (SELECT doc_id, len(toks) > 0 AND len(list_filter(toks, lambda t: contains(answer, t)))::DOUBLE / greatest(len(toks), 1) >= 0.6 AS ok FROM t)
    SELECT doc_id, round(count(*) FILTER (ok)::DOUBLE / count(*), 6) AS coverage FROM m GROUP BY doc_id""")
def mention_coverage(spark, d):
    """How far the next document mentions the sentences of each document."""
    a = docs(spark, d).select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("answer"))
    j = docs(spark, d).join(a, "doc_id")
    points = F.split("text", r"\. ")
    return j.select("doc_id", F.round(A.mention_coverage("answer", points), 6).alias("coverage"))


@query("answer_relevance", """WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations),
    w AS (SELECT *, list_filter(list_transform(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: length(x) > 4), lambda x: trim(lower(x), '?.,!():')),
        lambda x: NOT list_contains(""" + quoted(V.RELEVANCE_STOPWORDS) + """, x)) AS ws,
      regexp_replace(lower(strip_accents(answer)), '[^\\x00-\\x7F]', '', 'g') AS a FROM t WHERE answer IS NOT NULL)
    SELECT conv_id, turn, (len(ws) = 0 OR len(list_filter(ws, lambda x: contains(a, regexp_replace(strip_accents(x), '[^\\x00-\\x7F]', '', 'g')))) > 0) AS relevant FROM w""")
def answer_relevance(spark, d):
    """Is each turn relevant to the one before it?"""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").withColumn("answer", F.lead("text").over(w)).filter("answer is not null")
    return t.select("conv_id", "turn", A.is_relevant("text", "answer").alias("relevant"))


@query("parse_judgements", """WITH j AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'Insufficient.' WHEN 'click' THEN 'partial' WHEN 'view' THEN 'SUFFICIENT' WHEN 'signup' THEN '?' ELSE 'score ' || floor(value)::INT || '/100' END AS raw FROM events)
    SELECT event_id, CASE WHEN contains(upper(raw), 'INSUFFICIENT') THEN 'insufficient' WHEN contains(upper(raw), 'PARTIAL') THEN 'partial'
        WHEN contains(upper(raw), 'SUFFICIENT') THEN 'sufficient' ELSE 'partial' END AS verdict,
      try_cast(left(regexp_replace(raw, '[^0-9]', '', 'g'), 3) AS INT) AS score,
      least(try_cast(regexp_extract(raw, '[0-9]{1,9}') AS INT), 100) AS clamped FROM j""")
def parse_judgements(spark, d):
    e = events(spark, d)
    raw = (
        F.when(F.col("event_type") == "error", "Insufficient.").when(F.col("event_type") == "click", "partial")
        .when(F.col("event_type") == "view", "SUFFICIENT").when(F.col("event_type") == "signup", "?")
        .otherwise(F.concat(F.lit("score "), F.floor("value").cast("string"), F.lit("/100")))
    )
    return e.withColumn("raw", raw).select(
        "event_id", A.parse_verdict("raw").alias("verdict"), A.parse_score("raw").alias("score"), A.parse_score_clamped("raw").alias("clamped")
    )


# --- questions -----------------------------------------------------------------------------------

# Questions are phrased from the tables' words, so that every branch of the rules is met.
PHRASED = """phrased AS (SELECT event_id, CASE event_type
    WHEN 'click' THEN 'Qual a taxa de crescimento da tilápia do Nilo em ' || user_id || ' com restrição alimentar?'
    WHEN 'view' THEN 'What is the difference between ' || user_id || ' and restricted diet metabolism?'
    WHEN 'purchase' THEN 'O que é metabolismo ' || props || '?'
    WHEN 'signup' THEN 'How many Oreochromis niloticus, how was performed ' || value || '?'
    ELSE 'survival rate ' || value || ' why ' || props END AS q FROM events)"""


def phrased(spark, d):
    e = events(spark, d)
    user, value = F.col("user_id").cast("string"), F.col("value").cast("string")
    q = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("Qual a taxa de crescimento da tilápia do Nilo em "), user, F.lit(" com restrição alimentar?")))
        .when(F.col("event_type") == "view", F.concat(F.lit("What is the difference between "), user, F.lit(" and restricted diet metabolism?")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("O que é metabolismo "), "props", F.lit("?")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("How many Oreochromis niloticus, how was performed "), value, F.lit("?")))
        .otherwise(F.concat(F.lit("survival rate "), value, F.lit(" why "), "props"))
    )
    return e.select("event_id", q.alias("q"))


def lang_sql(q: str = "q") -> str:
    return (
        f"CASE WHEN {counted(f'lower({q})', V.LANGUAGE_PT_WORDS)} + CASE WHEN regexp_matches({q}, '{V.LANGUAGE_PT_ACCENTS}') THEN 2 ELSE 0 END"
        f" >= {counted(f'lower({q})', V.LANGUAGE_EN_WORDS)} THEN 'pt-BR' ELSE 'en' END"
    )


def rewrite_sql(q: str, lang: str) -> str:
    low = f"lower({q})"
    return f"""trim({q} || CASE WHEN {lang} = 'pt-BR' AND contains({low}, 'tilápia') AND contains({low}, 'nilo') THEN ' Oreochromis niloticus'
        WHEN {lang} = 'en' AND (contains({low}, 'oreochromis') OR contains({low}, 'niloticus')) THEN ' tilápia do nilo' ELSE '' END
      || CASE WHEN {counted(low, V.RESTRICTION_TERMS)} > 0 THEN CASE WHEN {lang} = 'pt-BR' THEN ' feed restriction' ELSE ' restrição alimentar' END ELSE '' END
      || CASE WHEN {lang} = 'pt-BR' AND contains({low}, 'metabolismo') THEN ' metabolism' WHEN {lang} = 'en' AND contains({low}, 'metabolism') THEN ' metabolismo' ELSE '' END)"""


@query("question_analysis", f"""WITH {PHRASED}, a AS (SELECT event_id, q, {lang_sql()} AS lang,
      {counted('lower(q)', V.QUANTITATIVE_PHRASES)} AS n, {counted('lower(q)', V.CONCEPTUAL_PHRASES)}
        + CASE WHEN starts_with(lower(q), 'o que ') OR starts_with(lower(q), 'quais ') THEN 1 ELSE 0 END AS c,
      {counted('lower(q)', V.COMPARATIVE_PHRASES)} AS v, {counted('lower(q)', V.METHODOLOGICAL_PHRASES)} AS m FROM phrased)
    SELECT event_id, lang AS language, CASE WHEN v > 0 AND v >= m THEN 'comparative' WHEN m > 0 THEN 'methodological'
      WHEN n > 0 AND n > c THEN 'quantitative' ELSE 'conceptual' END AS question_type, {rewrite_sql('q', 'lang')} AS rewritten FROM a""")
def question_analysis(spark, d):
    p = phrased(spark, d).withColumn("language", Q.question_language("q"))
    return p.select("event_id", "language", Q.question_type("q").alias("question_type"), Q.rewrite_query("q", "language").alias("rewritten"))


@query("retry_expansion", f"""WITH {PHRASED}, a AS (SELECT event_id, q, {lang_sql()} AS lang FROM phrased), b AS (SELECT event_id, {rewrite_sql('q', 'lang')} AS r FROM a)
    SELECT event_id, trim(r || CASE WHEN NOT contains(lower(r), 'tilápia') AND NOT contains(lower(r), 'tilapia') THEN ' tilapia tilápia' ELSE '' END
      || CASE WHEN NOT contains(lower(r), 'oreochromis') THEN ' Oreochromis niloticus' ELSE '' END) AS expanded FROM b""")
def retry_expansion(spark, d):
    return phrased(spark, d).select("event_id", Q.expand_for_retry("q").alias("expanded"))


@query("model_text_acceptance", f"""WITH t AS (SELECT conv_id, turn, text AS q, lag(text) OVER w AS last, lead(text) OVER w AS model FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    l AS (SELECT *, {lang_sql()} AS lang FROM t)
    SELECT conv_id, turn,
      CASE WHEN length(model) > length(q) AND contains(lower(model), lower(left(q, 20))) THEN model ELSE {rewrite_sql('q', 'lang')} END AS expansion,
      CASE WHEN length(trim(model)) >= 5 THEN trim(model) END AS paraphrase,
      CASE WHEN last IS NULL THEN q WHEN length(trim(model)) >= 5 THEN trim(model) ELSE trim(last || ' ' || q) END AS condensed FROM l""")
def model_text_acceptance(spark, d):
    """The next turn stands for the model's text, the turn before for the last question."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").select(
        "conv_id", "turn", F.col("text").alias("q"), F.lag("text").over(w).alias("last"), F.lead("text").over(w).alias("model")
    )
    return t.select(
        "conv_id", "turn", Q.accept_expansion("q", "model", Q.question_language("q")).alias("expansion"),
        Q.accept_paraphrase("model").alias("paraphrase"), Q.condense("q", "last", "model").alias("condensed"),
    )


@query("effective_type", """SELECT page_id, CASE WHEN label = 1 AND (length(trim(html, chr(10) || ' ')) < 200 OR
      (length(html) - length(replace(html, '?', '')))::DOUBLE / length(html) > 0.04) THEN 'conceptual'
      WHEN label = 1 THEN 'quantitative' ELSE 'comparative' END AS effective
    FROM pages JOIN embeddings ON vec_id = page_id""")
def effective_type(spark, d):
    j = html(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("page_id"), "label"), "page_id")
    kind = F.when(F.col("label") == 1, "quantitative").otherwise("comparative")
    return j.select("page_id", Q.effective_type(kind, "html").alias("effective"))


_STOP = quoted(V.LEXICAL_STOPWORDS)


@query("lexical_terms", f"""WITH t AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text || ' ' || source)), '[a-z0-9]+(?:\\.[0-9]+)*') AS ws FROM documents),
    u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
    k AS (SELECT doc_id, w, min(i) AS i FROM u WHERE length(w) >= 2 AND NOT list_contains({_STOP}, w) GROUP BY doc_id, w)
    SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS terms FROM k GROUP BY doc_id""")
def lexical_terms(spark, d):
    t = docs(spark, d).select("doc_id", Q.lexical_terms("text", "source").alias("t")).filter(F.size("t") > 0)
    return t.select("doc_id", F.array_join("t", " ").alias("terms"))


@query("lexical_terms_any_accent", ORACLE["lexical_terms"])
def lexical_terms_any_accent(spark, d):
    """The same terms from texts whose plain vowels carry marks beyond the Latin-1 letters."""
    marked = docs(spark, d).select("doc_id", F.translate("text", "aeio", "ąęįő").alias("text"), "source")
    t = X.with_folded_accents(marked, "text").select("doc_id", Q.lexical_terms("text", "source").alias("t")).filter(F.size("t") > 0)
    return t.select("doc_id", F.array_join("t", " ").alias("terms"))


# --- identity -----------------------------------------------------------------------------------


@query("dedup_key", """SELECT doc_id, CASE WHEN quality IS NOT NULL THEN 'db_id:' || doc_id
      ELSE 'meta:' || left(sha256(trim(source || ':' || CASE WHEN lang = 'en' THEN n_chars::VARCHAR ELSE '' END)), 12) END AS key
    FROM documents LEFT JOIN labels USING (doc_id)""")
def dedup_key(spark, d):
    j = docs(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    key = I.dedup_key(
        F.when(F.col("quality").isNotNull(), F.col("doc_id")), "source", F.when(F.col("lang") == "en", F.col("n_chars")), "text"
    )
    return j.select("doc_id", key.alias("key"))


def metadata(spark, d):
    """Metadata texts with every combination of missing fields."""
    en = F.col("lang") == "en"
    return docs(spark, d).select(
        "doc_id",
        F.to_json(
            F.struct(
                F.when(~F.col("lang").isin("de"), F.concat(F.when(F.col("lang") == "fr", "/tmp/up/").otherwise("/data/"), "source", F.lit(".pdf"))).alias("source"),
                F.when(F.col("n_chars") > 1000, F.concat(F.lit("Title "), "source")).alias("title"),
                F.when(en, F.concat("source", F.lit(" name.pdf"))).alias("original_file_name"),
                F.when(en & (F.col("n_chars") > 500), F.sha2("source", 256)).alias("original_file_id"),
                F.col("n_chars").alias("page"),
            )
        ).alias("metadata"),
    )


META = """meta AS (SELECT doc_id,
    CASE WHEN lang <> 'de' THEN CASE WHEN lang = 'fr' THEN '/tmp/up/' ELSE '/data/' END || source || '.pdf' END AS src,
    CASE WHEN n_chars > 1000 THEN 'Title ' || source END AS title,
    CASE WHEN lang = 'en' THEN source || ' name.pdf' END AS name,
    CASE WHEN lang = 'en' AND n_chars > 500 THEN sha256(source) END AS fid, n_chars FROM documents),
  named AS (SELECT *, coalesce(name, CASE WHEN contains(src, 'tmp') THEN title END, regexp_extract(src, '[^/]*$'), 'unknown') AS file_name FROM meta)"""


@query("file_identity", f"WITH {META} SELECT doc_id, file_name, coalesce(fid, md5(file_name)) AS file_id FROM named")
def file_identity(spark, d):
    return metadata(spark, d).select("doc_id", I.file_name("metadata").alias("file_name"), I.file_id("metadata").alias("file_id"))


@query("object_path", """SELECT doc_id, sha256(text) || CASE WHEN lang = 'en' THEN '.pdf' ELSE '.txt' END AS path FROM documents""")
def object_path(spark, d):
    name = F.when(F.col("lang") == "en", F.col("source")).otherwise(F.concat("source", F.lit(".x.txt")))
    return docs(spark, d).select("doc_id", I.object_path(F.sha2("text", 256), name).alias("path"))


@query("first_non_blank", """SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_name END, CASE WHEN c_nationkey > 12 THEN c_mktsegment END, 'none') AS value FROM customer""")
def first_non_blank(spark, d):
    c = table(spark, d, "customer")
    a = F.when(F.col("c_acctbal") > 5000, F.concat(F.lit(" "), "c_name", F.lit("\n"))).otherwise("  \t")
    b = F.when(F.col("c_nationkey") > 12, F.col("c_mktsegment"))
    return c.select("c_custkey", I.first_non_blank(a, b, F.lit("none")).alias("value"))


@query("parse_ts", """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""")
def parse_ts(spark, d):
    e = events(spark, d)
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("bad "), "props")).when(
        F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.withColumn("parsed", I.parse_ts(raw)).select("event_id", ts("parsed"))


@query("sanitize_filename", r"""SELECT page_id, left(CASE WHEN s = '' THEN 'arquivo' ELSE s END, 200) AS name
    FROM (SELECT page_id, trim(regexp_replace(regexp_replace(u, '\p{C}', '', 'g'), '[^A-Za-z0-9._ -]+', '_', 'g'), ' ._') AS s
      FROM (SELECT page_id, url AS u FROM pages UNION ALL SELECT doc_id + 1000000, text FROM documents))""")
def sanitize_filename(spark, d):
    a = html(spark, d).select("page_id", F.col("url").alias("u"))
    b = docs(spark, d).select((F.col("doc_id") + 1000000).alias("page_id"), F.col("text").alias("u"))
    return X.with_nfkc(a.unionByName(b), "u").select("page_id", I.sanitize_filename("u").alias("name"))


@query("mask_email", """SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN '***' WHEN c_nationkey < 8 THEN '***@' || c_mktsegment ELSE left(lower(c_name), 1) || '***@' || c_mktsegment END AS masked FROM customer""")
def mask_email(spark, d):
    c = table(spark, d, "customer")
    n = F.col("c_nationkey")
    mail = F.when(n < 5, F.col("c_name")).when(n < 8, F.concat(F.lit("@"), "c_mktsegment")).otherwise(F.concat(F.lower("c_name"), F.lit("@"), "c_mktsegment"))
    return c.select("c_custkey", I.mask_email(mail).alias("masked"))


@query("client_ip", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '10.0.0.' || o_custkey WHEN o_orderstatus = 'O' THEN 'b' || o_custkey ELSE 'peer' END AS ip FROM orders""")
def client_ip(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_custkey").cast("string")
    s = F.col("o_orderstatus")
    xff = F.when(s == "F", F.concat(F.lit("evil, 10.0.0."), k, F.lit(" , 9.9.9.9"))).when(s == "O", F.concat(F.lit("a,b"), k, F.lit(",c,,"))).otherwise("only")
    return o.select("o_orderkey", I.client_ip(xff, F.lit("peer")).alias("ip"))


@query("with_role", """SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'admin' ELSE 'user' END AS role, c_mktsegment IN ('BUILDING', 'MACHINERY') AS is_admin FROM customer""")
def with_role(spark, d):
    from corpuscle.operators.tables import with_role as apply

    c = table(spark, d, "customer")
    role = F.when(F.col("c_mktsegment") == "BUILDING", "Admin").when(F.col("c_mktsegment") == "MACHINERY", "ADMINISTRATOR").when(
        F.col("c_mktsegment") == "HOUSEHOLD", "owner"
    )
    return apply(c.select("c_custkey", role.alias("role")))


# --- measures -----------------------------------------------------------------------------------


@query("kvol", f"WITH {ANALYSES} SELECT id, floor(kvol * 1e4)::BIGINT AS kvol FROM analyses")
def kvol(spark, d):
    return analyses(spark, d).select("id", F.floor(F.col("kvol") * 1e4).alias("kvol"))


@query("marker_scale", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity, 1) AS quantity, round(CASE WHEN l_discount > 0.05 THEN l_discount * 1000
      WHEN l_tax > 0 THEN (sqrt(pow(l_quantity, 2) + 9) * 2 + sqrt(pow(l_linenumber, 2) + 16) * 2) / 4 / 2.5 END, 4) AS scale FROM lineitem""")
def marker_scale(spark, d):
    """A parallelogram spanned by (quantity, 3) and (line number, 4) as marker of 2.5 cm."""
    li = table(spark, d, "lineitem")
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")

    def p(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    zero = F.lit(0.0)
    corners = F.array(p(zero, zero), p(q, F.lit(3.0)), p(q + n, F.lit(7.0)), p(n, F.lit(4.0)))
    manual = F.when(F.col("l_discount") > 0.05, F.col("l_discount") * 1000).otherwise(0.0)
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_quantity", 1).alias("quantity"),
        F.round(M.effective_scale(manual, F.when(F.col("l_tax") > 0, corners), 2.5), 4).alias("scale"),
    )
