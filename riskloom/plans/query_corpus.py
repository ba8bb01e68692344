"""Registered queries: text cleaning, corpus curation, vocabulary, encoding, split, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import text
from ..operators import curate, detect, model, skew
from . import jobs
from . import tables as t
from .registry import query

VOCABULARY_SIZE = 10_000


def _cleaned(spark, base):
    return t.source_files(spark, base).select("doc_id", text.clean_text(F.col("code")).alias("c"))


def _digest(df, column="x"):
    """Line count and MD5 of a text, so that whole texts are compared."""
    lines = F.when(F.col(column) == "", 0).otherwise(F.size(F.split(column, "\n")))
    return df.select("doc_id", lines.alias("n_lines"), F.md5(column).alias("md5"))


def _digest_sql(body: str) -> str:
    return ("SELECT doc_id, (CASE WHEN x = '' THEN 0 ELSE len(string_split(x, chr(10))) END)::INT "
            f"AS n_lines, md5(x) AS md5 FROM (SELECT doc_id, {body} AS x FROM documents)")


@query("strip_comments", _digest_sql(t.hash_comments_sql(t.clean_sql("text"))))
def strip_comments(spark, base):
    return _digest(_cleaned(spark, base).withColumn("x", text.strip_hash_comments(F.col("c"))))


C_SQL = f"regexp_replace({t.clean_sql('text')}, '//[^\\n]*|/\\*[\\s\\S]*?\\*/', '', 'g')"


@query("strip_comments_c", _digest_sql(f"array_to_string({t.no_blank_sql(C_SQL)}, chr(10))"))
def strip_comments_c(spark, base):
    return _digest(_cleaned(spark, base).withColumn("x", text.strip_c_comments(F.col("c"))))


@query("normalise_literals", _digest_sql(t.mask_sql(t.clean_sql("text"))))
def normalise_literals(spark, base):
    return _digest(_cleaned(spark, base).withColumn("x", text.mask_literals(F.col("c"))))


BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
INDENT = ("list_transform({ls}, lambda l: repeat(' ', ((4 * (length(regexp_extract(l, "
          "'^[ \\t]*')) - length(replace(regexp_extract(l, '^[ \\t]*'), chr(9), ''))) + "
          "(length(regexp_extract(l, '^[ \\t]*')) - length(replace(regexp_extract(l, "
          "'^[ \\t]*'), ' ', '')))) // 4) * 4) || regexp_replace(l, '^[ \\t]*', ''))")
CUT = (f"list_filter(list_transform(string_split_regex(text, '{BREAKS}'), lambda l: "
       r"regexp_replace(split_part(l, '#', 1), '[\s\p{Z}]+$', '')), lambda l: l <> '')")


@query("clean_code", _digest_sql(f"array_to_string({INDENT.format(ls=CUT)}, chr(10))"))
def clean_code(spark, base):
    return _digest(t.source_files(spark, base).withColumn("x", text.clean_code(F.col("code"))))


INDENTED = "regexp_replace(text, '\\n', chr(10) || chr(9) || '   ', 'g')"
NO_TAIL = f"regexp_replace({INDENTED}, '\\n$', '')"


@query("normalise_indent", _digest_sql("array_to_string(" + INDENT.format(
    ls=f"string_split({NO_TAIL}, chr(10))") + ", chr(10))"))
def normalise_indent(spark, base):
    files = t.source_files(spark, base).withColumn(
        "code", F.regexp_replace("code", r"\n", "\n\t   "))
    return _digest(files.withColumn("x", text.normalise_indent(F.col("code"))))


def _all_tokens(column="tokens"):
    """A digest of the whole list, and its beginning to be looked at."""
    return (F.array_join(F.slice(column, 1, 5), " ").alias("first_five"),
            F.md5(F.array_join(column, "\n")).alias(f"{column}_md5"))


NORMAL = {"normal": f"SELECT doc_id, lang, source, {t.normal_sql('text')} AS x FROM documents",
          "tokenised": f"SELECT *, regexp_extract_all(x, '{t.TOKENS_SQL}') AS toks FROM normal"}


def _tokenised(spark, base):
    files = t.source_files(spark, base)
    return curate.normalise(files, "code", F.lit("py"))


@query("normalise_tokens", t.with_ctes((), (
    "SELECT doc_id, len(toks)::INT AS n_tokens, array_to_string(toks[1:5], ' ') AS first_five, "
    "md5(array_to_string(toks, chr(10))) AS tokens_md5 FROM tokenised WHERE len(toks) > 0"), **NORMAL))
def normalise_tokens(spark, base):
    return _tokenised(spark, base).select(
        "doc_id", F.col("token_length").alias("n_tokens"), *_all_tokens())


SCAN_SQL = r"[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+|[^\s\p{Z}\p{L}\p{N}_]"


@query("raw_tokens", (
    "SELECT doc_id, len(a)::INT AS n_tokens, len(b)::INT AS n_shown, array_to_string(a[1:5], ' ')"
    " AS first_five, md5(array_to_string(a, chr(10))) AS tokens_md5, md5(array_to_string(b, chr(10))) AS "
    f"shown_md5 FROM (SELECT doc_id, regexp_extract_all(text, '{SCAN_SQL}') AS a, "
    "regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*') AS b FROM documents)"))
def raw_tokens(spark, base):
    files = t.source_files(spark, base)
    return (files.withColumn("tokens", text.scan_tokens(F.col("code")))
            .withColumn("shown", text.display_tokens(F.col("code")))
            .select("doc_id", F.size("tokens").alias("n_tokens"),
                    F.size("shown").alias("n_shown"), *_all_tokens(), _all_tokens("shown")[1]))


# Curation ----------------------------------------------------------------------------

@query("corpus_clean", t.with_ctes(("rated_labelled",), (
    "SELECT ord AS doc_id, language, label, code_hash, length(c)::INT AS n_chars FROM hashed"),
    **t.clean_ctes("rated_labelled")))
def corpus_clean(spark, base):
    clean = curate.clean_labelled(t.rated_labelled(spark, base))
    return clean.select(F.col("ord").alias("doc_id"), "language", "label", "code_hash",
                        F.length("code_clean").alias("n_chars"))


PARITY = t.clean_ctes("parity_labelled")


def _parity(spark, base):
    return curate.clean_labelled(t.parity_labelled(spark, base))


@query("conflict_drop", t.with_ctes(("parity_labelled",), (
    "SELECT ord AS doc_id, label, code_hash FROM hashed WHERE code_hash IN (SELECT code_hash FROM "
    "hashed GROUP BY 1 HAVING min(label) = max(label))"), **PARITY))
def conflict_drop(spark, base):
    return curate.drop_conflicting(_parity(spark, base)).select(
        F.col("ord").alias("doc_id"), "label", "code_hash")


@query("dedupe_first", t.with_ctes(("parity_labelled",), (
    "SELECT ord AS doc_id, code_hash FROM (SELECT *, row_number() OVER (PARTITION BY code_hash, "
    "label ORDER BY ord) AS rn FROM hashed) WHERE rn = 1"), **PARITY))
def dedupe_first(spark, base):
    return curate.dedupe_first(_parity(spark, base)).select(
        F.col("ord").alias("doc_id"), "code_hash")


@query("language_slice", t.with_ctes(("parity_labelled",), (
    "SELECT ord AS doc_id, label FROM hashed WHERE language = 'en'"), **PARITY))
def language_slice(spark, base):
    return curate.language_slice(_parity(spark, base), "en").select(
        F.col("ord").alias("doc_id"), "label")


@query("dedup_audit", (
    "SELECT lang, count(*) AS rows, count(DISTINCT h) AS unique_hashes, count(*) - count(DISTINCT "
    f"h) AS duplicates FROM (SELECT lang, sha256({t.strip_sql('text')}) AS h FROM documents) "
    "GROUP BY 1"))
def dedup_audit(spark, base):
    return curate.copy_audit(t.source_files(spark, base), ["language"]).withColumnRenamed(
        "language", "lang")


AUDITED = ("SELECT d.source AS repo, text, coalesce(lower(lang) IN ('en', 'es'), false) AS inside, "
           "CASE quality WHEN 1 THEN 'safe' WHEN 0 THEN 'vulnerable' END AS safety FROM documents d "
           "LEFT JOIN labels l ON l.doc_id = d.doc_id")


@query("raw_audit", t.with_ctes((), (
    "SELECT repo, count(*) AS records, count(*) FILTER (inside) AS slice_rows, count(*) FILTER (inside "
    "AND safety = 'safe') AS safe, count(*) FILTER (inside AND safety = 'vulnerable') AS vulnerable, "
    "count(DISTINCT h) AS unique_hashes, count(h) - count(DISTINCT h) AS duplicates FROM (SELECT *, CASE "
    f"WHEN inside AND safety IS NOT NULL THEN sha256({t.strip_sql('text')}) END AS h FROM audited) "
    "GROUP BY 1"), audited=AUDITED))
def raw_audit(spark, base):
    quality = F.col("quality")
    hashed = t.source_files(spark, base).select(
        "doc_id", "repo", "language", text.sha256_stripped(F.col("code")).alias("digest"))
    rated = hashed.join(t.load(spark, base, "labels"), "doc_id", "left").select(
        "repo", "digest", F.upper("language").alias("language"),
        F.when(quality == 1, "safe").when(quality == 0, "vulnerable").alias("safety"))
    return curate.raw_audit(rated, ["repo"], ["en", "es"], digest="digest")


# The documents are prose, hence hash-comment stripping applies to every language here.
CURATED = PARITY | {
    "resolved": t.RESOLVED,
    "normal": f"SELECT ord AS doc_id, label, {t.normal_sql('c')} AS x FROM resolved",
    "curated": f"SELECT *, regexp_extract_all(x, '{t.TOKENS_SQL}') AS toks FROM normal "
               f"WHERE len(regexp_extract_all(x, '{t.TOKENS_SQL}')) > 0"}


def _curated(spark, base):
    labelled = t.parity_labelled(spark, base).withColumn("language", F.lit("Python "))
    return jobs.curated(labelled).withColumnRenamed("ord", "doc_id")


@query("curated_corpus", t.with_ctes(("parity_labelled",), (
    "SELECT doc_id, label, len(toks)::INT AS token_length, md5(x) AS md5 FROM curated"),
    **CURATED))
def curated_corpus(spark, base):
    return _curated(spark, base).select("doc_id", "label", "token_length",
                                        F.md5("normalized_code").alias("md5"))


@query("corpus_union", t.with_ctes(("parity_labelled", "rated_labelled"), (
    "SELECT part, doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY x, label ORDER BY "
    "part, doc_id) AS rn FROM both_) WHERE rn = 1"),
    **CURATED,
    rated=t.CLEANED.replace("{src}", "rated_labelled"),
    rnormal=f"SELECT ord AS doc_id, label, {t.normal_sql('c')} AS x FROM rated",
    both_="SELECT 'rated' AS part, doc_id, label, x FROM rnormal WHERE len(regexp_extract_all(x, "
          f"'{t.TOKENS_SQL}')) > 0 AND doc_id IN (SELECT ord FROM rated WHERE length(c) > 10) "
          "UNION ALL SELECT 'zparity', doc_id, label, x FROM curated"))
def corpus_union(spark, base):
    rated = curate.normalise(curate.clean_labelled(t.rated_labelled(spark, base)),
                             language=F.lit("py"))
    parts = [jobs.settle(df.select("doc_id", "label", "normalized_code",
                                   F.col("doc_id").alias("ord"), F.lit(name).alias("part")), name)
             for name, df in (("rated", rated.withColumnRenamed("ord", "doc_id")),
                              ("zparity", _curated(spark, base)))]
    return curate.union_corpora(parts).select("part", "doc_id", "label")


SIDES = {"sides": "SELECT conv_id, turn, source_category, code, CASE side WHEN 'bad' THEN 1 "
                  "ELSE 0 END AS label FROM diff_rows WHERE side IS NOT NULL AND "
                  f"length({t.strip_sql('code')}) > 10",
         "names": "SELECT * FROM (VALUES " + ", ".join(
             f"('{k}', '{v}')" for k, v in fixed.DIFF_CATEGORIES.items()) + ") AS n(category, cwe)",
         "named": "SELECT s.*, coalesce(cwe, 'CWE-Other') AS cwe FROM sides s LEFT JOIN names n "
                  "ON n.category = s.source_category"}


def _sides(spark, base):
    return detect.attach_category(curate.diff_sides(t.diff_rows(spark, base)))


@query("diff_sides", t.with_ctes(("diff_rows",), (
    "SELECT conv_id, turn, label, CASE label WHEN 1 THEN 'vulnerable' ELSE 'safe' END AS safety, "
    "md5(code) AS md5 FROM sides"), **SIDES))
def diff_sides(spark, base):
    return _sides(spark, base).select("conv_id", "turn", "label", "safety",
                                      F.md5("code").alias("md5"))


@query("category_lookup", t.with_ctes(
    ("diff_rows",), "SELECT conv_id, turn, source_category, cwe FROM named", **SIDES))
def category_lookup(spark, base):
    return _sides(spark, base).select("conv_id", "turn", "source_category", "cwe")


@query("category_distribution", t.with_ctes(
    ("diff_rows",), "SELECT cwe, count(*) AS n FROM named GROUP BY 1", **SIDES))
def category_distribution(spark, base):
    return curate.value_counts(_sides(spark, base), "cwe")


# Vocabulary, encoding, split ---------------------------------------------------------

FREQUENCY = NORMAL | {"freq": "SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token "
                              "FROM tokenised) GROUP BY 1"}
RESERVED = "(" + ", ".join(f"'{r}'" for r in fixed.RESERVED_TOKENS) + ")"
VOCABULARY = FREQUENCY | {
    "top": f"SELECT * FROM freq ORDER BY n DESC, token LIMIT {VOCABULARY_SIZE - 7}",
    "vocab": "SELECT token, id FROM (VALUES " + ", ".join(
        f"('{r}', {i})" for i, r in enumerate(fixed.RESERVED_TOKENS)) + ") AS r(token, id) "
        "UNION ALL SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 6)::INT FROM top "
        f"WHERE token NOT IN {RESERVED}"}


@query("token_frequency", t.with_ctes((), "SELECT token, n FROM freq", **FREQUENCY))
def token_frequency(spark, base):
    return curate.token_frequency(_tokenised(spark, base))


@query("vocabulary", t.with_ctes((), "SELECT token, id FROM vocab", **VOCABULARY))
def vocabulary(spark, base):
    return curate.build_vocabulary(_tokenised(spark, base), max_size=VOCABULARY_SIZE)


@query("encode_pad", t.with_ctes((), (
    "SELECT doc_id, array_to_string(ids || list_transform(range(200 - len(ids)), lambda x: 0), "
    "' ') AS features FROM (SELECT doc_id, list(coalesce(id, 1) ORDER BY pos) AS ids FROM spots s "
    "LEFT JOIN vocab v ON v.token = s.token GROUP BY 1)"), **VOCABULARY,
    spots="SELECT doc_id, unnest(toks[1:200]) AS token, generate_subscripts(toks[1:200], 1) AS "
          "pos FROM tokenised"))
def encode_pad(spark, base):
    tokens = jobs.settle(_tokenised(spark, base).select("doc_id", "tokens"), "tokens")
    vocab = curate.build_vocabulary(tokens, max_size=VOCABULARY_SIZE)
    return curate.encode_tokens(tokens, vocab, "doc_id").select(
        "doc_id", F.array_join(F.transform("features", lambda i: i.cast("string")), " ")
        .alias("features"))


SPLIT = {
    "counted": "SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM labelled_ "
               "GROUP BY label",
    "sizes": "SELECT *, ceil(total * 0.3::DOUBLE) AS held FROM counted",
    "goals": "SELECT *, total - held AS train_all, held - ceil(held * (0.15::DOUBLE / "
             "0.3::DOUBLE)) AS val_all FROM sizes",
    "train1": "SELECT *, train_all * n / total::DOUBLE AS ex FROM goals",
    "train2": "SELECT *, floor(ex) + CASE WHEN row_number() OVER (ORDER BY ex - floor(ex) DESC, "
              "label) <= train_all - sum(floor(ex)) OVER () THEN 1 ELSE 0 END AS train FROM train1",
    "val1": "SELECT *, val_all * (n - train) / (sum(n - train) OVER ())::DOUBLE AS ev FROM train2",
    "val2": "SELECT *, floor(ev) + CASE WHEN row_number() OVER (ORDER BY ev - floor(ev) DESC, "
            "label) <= val_all - sum(floor(ev)) OVER () THEN 1 ELSE 0 END AS val FROM val1",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || doc_id), "
              "doc_id) AS rn FROM labelled_",
    "split": "SELECT r.*, CASE WHEN rn <= train THEN 'train' WHEN rn <= train + val THEN 'val' "
             "ELSE 'test' END AS split FROM ranked r JOIN val2 v ON v.label = r.label"}


@query("stratified_split", t.with_ctes(("parity_labelled",), (
    "SELECT doc_id, label, split FROM split"), **PARITY,
    labelled_="SELECT ord AS doc_id, label FROM hashed", **SPLIT))
def stratified_split(spark, base):
    rows = _parity(spark, base).select(F.col("ord").alias("doc_id"), "label")
    return curate.stratified_split(jobs.settle(rows, "labelled"), "doc_id")


@query("dataset_summary", t.with_ctes(("parity_labelled",), (
    "SELECT coalesce(split, 'all') AS split, count(*) AS total, count(*) FILTER (label = 1) AS "
    "vulnerable, count(*) FILTER (label = 0) AS safe, round_even(avg(n), 4) AS mean_length, "
    "median(n) AS median_length, max(n)::INT AS max_length, min(n)::INT AS min_length FROM split "
    "GROUP BY ROLLUP (split)"),
    **CURATED, labelled_="SELECT doc_id, label, len(toks) AS n FROM curated", **SPLIT))
def dataset_summary(spark, base):
    rows = _curated(spark, base).select("doc_id", "label", "token_length")
    split = curate.stratified_split(jobs.settle(rows, "curated"), "doc_id")
    return curate.dataset_summary(split).withColumn("mean_length", F.bround("mean_length", 4))


@query("class_weight", t.with_ctes(("parity_labelled",), (
    "SELECT p AS n_vulnerable, q AS n_safe, round_even(q / p::DOUBLE, 6) AS pos_weight, "
    "round_even(q / p::DOUBLE * 1.2::DOUBLE, 6) AS loss_weight FROM (SELECT count(*) FILTER "
    "(label = 1) AS p, count(*) FILTER (label = 0) AS q FROM hashed)"), **PARITY))
def class_weight(spark, base):
    return curate.class_weight(_parity(spark, base))


# Paths -------------------------------------------------------------------------------

DIRS = "list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1)"
IGNORED = (*fixed.IGNORED_DIRS, "es", "de")
PARTS = (*fixed.UPLOAD_IGNORED_PARTS, "/fr/")


def _quoted(values):
    return ", ".join(f"'{v}'" for v in values)


@query("path_prune", t.with_ctes(("uploads",), (
    f"SELECT page_id, path, len(list_filter({DIRS}, lambda d: lower(d) IN ({_quoted(IGNORED)}) "
    "OR starts_with(d, '.'))) = 0 AS kept FROM uploads")))
def path_prune(spark, base):
    return t.uploads(spark, base).withColumn("kept", text.path_kept(F.col("path"), IGNORED))


@query("path_prune_substring", t.with_ctes(("uploads",), (
    "SELECT page_id, suffix(p, '.py') AND NOT (" + " OR ".join(
        f"contains(p, '{part}')" for part in PARTS) + ") AS kept FROM (SELECT page_id, '/' || "
    "lower(replace(path, '.html', '.py')) AS p FROM uploads)")))
def path_prune_substring(spark, base):
    path = F.replace("path", F.lit(".html"), F.lit(".py"))
    return t.uploads(spark, base).select("page_id", text.upload_path_kept(path, PARTS).alias("kept"))


@query("ext_filter", t.with_ctes(("uploads",), (
    "SELECT page_id, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), "
    r"'^\.*[^.].*(\.[^.]*)$', 1)) = '.html' AS matches FROM uploads")))
def ext_filter(spark, base):
    return t.uploads(spark, base).select(
        "page_id", text.has_extension(F.col("path"), ".html").alias("matches"))


@query("path_display", t.with_ctes(("uploads",), (
    "SELECT page_id, split_part(p, '/', 1) AS folder_name, regexp_extract(p, '([^/]*)$', 1) AS "
    "file_name FROM (SELECT page_id, trim(path, '/') AS p FROM uploads)")))
def path_display(spark, base):
    path = F.col("path")
    return t.uploads(spark, base).select(
        "page_id", text.display_name(path, F.lit(2)).alias("folder_name"),
        text.display_name(path, F.lit(1)).alias("file_name"))


@query("attribution_topk", t.with_ctes((), (
    "SELECT doc_id, string_agg(token, ' ' ORDER BY w DESC, pos DESC) AS tokens FROM (SELECT *, "
    "row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, pos DESC) AS rn FROM weighted WHERE "
    f"length(token) > 2 AND token NOT IN {RESERVED}) WHERE rn <= 5 GROUP BY 1"),
    **FREQUENCY,
    spots="SELECT doc_id, token, count(*) AS k, min(pos) AS pos FROM (SELECT doc_id, unnest(toks) "
          "AS token, generate_subscripts(toks, 1) AS pos FROM tokenised) GROUP BY 1, 2",
    weighted="SELECT s.*, (1::DOUBLE / n) * k AS w FROM spots s JOIN freq f ON f.token = s.token"))
def attribution_topk(spark, base):
    """Tokens of a document by share of all their occurrences."""

    tokens = jobs.settle(_tokenised(spark, base).select("doc_id", "tokens"), "tokens")
    weights = curate.token_frequency(tokens).withColumn("weight", F.lit(1.0) / F.col("n"))
    weighted = model.token_weights(tokens, weights, "doc_id", count="n")
    top = skew.compute_once(weighted, tokens=detect.ranked_tokens(F.col("token_weights")))
    return top.where(F.size("tokens") > 0).select("doc_id", F.array_join("tokens", " ")
                                                  .alias("tokens"))
