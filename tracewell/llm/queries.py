"""Queries over the given tables, one per operator of this subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.llm.common import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op1_substring_dedup")
def op1(spark, folder):
    from tracewell.llm.substring import substring_dedup

    out = substring_dedup(read(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_simhash_near_dedup")
def op7(spark, folder):
    from tracewell.llm.simhash import simhash_groups

    out = simhash_groups(read(spark, folder, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


@query("op2_benchmark_leaks")
def op2(spark, folder):
    from tracewell.llm.decontaminate import leaked_items

    return leaked_items(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query("op4_pii_spans")
def op4(spark, folder):
    from tracewell.llm.pii import BASE_KINDS, pii_spans

    found = pii_spans(read(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query("op3_token_counts")
def op3(spark, folder):
    """Counts of every document before and after the edits that redact its personal data."""
    from tracewell.llm.pii import redaction_edits
    from tracewell.llm.tokens import recount_tokens

    return recount_tokens(redaction_edits(read(spark, folder, "documents")), RANKS, state=False)


@query("op5_toxicity")
def op5(spark, folder):
    from tracewell.llm.toxicity import toxicity_scores

    return toxicity_scores(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op9_quality_rules")
def op9(spark, folder):
    from tracewell.llm.quality import STATISTICS, judge, learn_rules

    docs = read(spark, folder, "documents")
    out = judge(docs, learn_rules(docs, read(spark, folder, "labels")))
    return out.select(F.col("row.doc_id").alias("doc_id"), *STATISTICS, "base_failed", "kept", "rule")


def mix_tree():
    from tracewell.llm.mixing import Tree

    return Tree(
        domain="CASE WHEN source = 'src0' THEN 'web' WHEN length(source) = 4 THEN 'books' ELSE 'reference' END",
        domains={"web": 50, "books": 30, "reference": 20},
        langs={"en": 40, "de": 25, "fr": 20, "es": 15},
    )


def _op6_sql() -> str:
    from tracewell.llm.mixing import mix_sql

    return mix_sql(mix_tree(), "doc_id, t_domain AS domain, lang, source, n AS n_tokens")


@query("op6_source_mix", _op6_sql())
def op6(spark, folder):
    from tracewell.llm.mixing import mix, token_count

    tree = mix_tree()
    out = mix(read(spark, folder, "documents"), tree)
    return out.select("doc_id", F.coalesce(F.expr(tree.domain), F.lit("")).alias("domain"), "lang", "source", token_count("text").alias("n_tokens"), "times")


# The rules of the contract, and hosts that no rule decides.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BLOCKED_NAMES = ["spam-farm", "adult-x", "casino-win", "cheap-pills", "free-bets", "ads-track"]
BLOCKED_HOSTS = [f"{name}.example.{end}" for name in BLOCKED_NAMES for end in ("com", "net", "org")]


def _op8_sql() -> str:
    fits = lambda h: f"(host = '{h}' OR suffix(host, '.{h}'))"
    ordered = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h)} AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in ordered)
    verdict = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in ordered)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH rests AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
    ruled AS (SELECT *, CASE {rule} END AS rule FROM parts)
    SELECT page_id, host, path, rule,
           CASE {verdict} WHEN {' OR '.join(map(fits, BLOCKED_HOSTS))} THEN 'block' ELSE 'allow' END AS verdict
    FROM ruled"""


@query("op8_url_filter", _op8_sql())
def op8(spark, folder):
    from tracewell.llm.urls import Rule, judge_urls

    pages = read(spark, folder, "pages").select("page_id", "url")
    entries = spark.createDataFrame([(h,) for h in BLOCKED_HOSTS], "entry string")
    out = judge_urls(pages, entries, [Rule(*r) for r in URL_RULES])
    return out.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


def _periodic_damage(docs):
    """Words from a document-dependent place on repeated with a period, in a tenth of the documents (by their id)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), 0)
    hit = docs.where(h % 10 == 0).select("doc_id", words.alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w")
    hit = hit.select("doc_id", "w", "g", (F.col("g") % F.greatest(n, F.lit(1))).cast("int").alias("a"))
    hit = hit.select("doc_id", "w", "a", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    taken = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.element_at("w", F.col("a") + (i - F.col("a")) % F.col("p") + 1))
    hit = hit.select("doc_id", F.array_join(F.transform("w", taken), " ").alias("text"))
    return docs.where(F.coalesce(h % 10 != 0, F.lit(True))).select("doc_id", "text").unionAll(hit)


@query("op11_periodic_runs")
def op11(spark, folder):
    """Runs of the damaged documents; a null id is damaged nowhere."""
    from tracewell.llm.periodic import periodic_runs

    found = periodic_runs(_periodic_damage(read(spark, folder, "documents")))
    text = lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(text(x), F.lit("\n"))), "")
    order = F.transform("runs", lambda x: F.struct((-x["length"]).alias("less"), x["start"].alias("start"), x["period"].alias("period")))
    top = F.array_min(order)
    out = found.select("doc_id", "n_words", F.size("runs").cast("bigint").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("top.less"), F.col("top.period")
    return out.select(
        "doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words",
    )


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@query("op12_bpe_round_trip")
def op12(spark, folder):
    from tracewell.llm.bpe import decode_ids, encode_texts

    out = decode_ids(encode_texts(read(spark, folder, "documents"), TOKENIZER), TOKENIZER)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def _damaged_turns(rows):
    """Turns dropped, emptied, cut, repeated or given to the user, by the crc32 of `conv_id:turn`."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    copies = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    role = F.when(h == 4, "user").otherwise(said("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), copies))).drop("col")


def _op13_sql() -> str:
    from tracewell.llm.conversations import DELETE, INSERT, REROLE, TRUNCATED

    never = 10**9
    stays = f"CASE WHEN letter IN ('S', 'U', 'A', 'O') THEN {TRUNCATED} ELSE 0 END"
    keeps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    after = (2, 2, 3, 2)

    def way(state: int) -> str:
        kept = " ".join(f"WHEN lower(letter) = '{c}' THEN {{'c': {stays} + v{t}.c, 'a': 'K' || v{t}.a}}" for c, t in keeps[state].items())
        none = f"{{'c': {never}, 'a': ''}}"
        given = f"CASE WHEN letter = 'x' THEN {none} ELSE {{'c': {REROLE} + {stays} + v{after[state]}.c, 'a': 'R' || v{after[state]}.a}} END"
        return f"list_sort([{{'c': {DELETE} + v{state}.c, 'a': 'D' || v{state}.a}}, {given}, CASE {kept} ELSE {none} END])[1]"

    insert = lambda before: ", ".join(f"list_sort([{before}{g}, {{'c': {INSERT} + {before}{after[g]}.c, 'a': 'I' || {before}{after[g]}.a}}])[1]" for g in range(4))
    named = lambda values, name: ", ".join(f"{v} AS {name}{i}" for i, v in enumerate(values))
    split = lambda text: [f"list_sort({x}" for x in text.split("list_sort(")[1:]]
    first = named([x.rstrip(", ") for x in split(insert("b"))], "i")
    second = named([x.rstrip(", ") for x in split(insert("i"))], "v")
    return f"""
    WITH RECURSIVE crc AS (
      SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1))) ORDER BY i) AS t FROM range(256) AS r(i)),
    said AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    hashed AS (
      SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ord(substr(k, i::INT, 1))::BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h FROM said, crc),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged),
    judged AS (
      SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
             coalesce(lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY pos) || role[1:1] NOT IN ('su', 'ua', 'au'), false) AS illegal FROM placed),
    lettered AS (
      SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(i) ELSE i END AS letter
      FROM (SELECT *, CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE 'o' END AS i FROM judged)),
    convs AS (
      SELECT conv_id, count(*) AS n, list(letter ORDER BY pos) AS letters, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (illegal) AS illegal FROM lettered GROUP BY conv_id),
    steps AS (
      SELECT conv_id, letters, n AS k, {{'c': 0, 'a': ''}} AS v0, {{'c': {2 * INSERT}, 'a': 'II'}} AS v1, {{'c': {INSERT}, 'a': 'I'}} AS v2, {{'c': 0, 'a': ''}} AS v3 FROM convs
      UNION ALL
      SELECT conv_id, letters, k, {second} FROM (
        SELECT conv_id, letters, k, b0, b1, b2, b3, {first} FROM (
          SELECT conv_id, letters, k - 1 AS k, {named([way(g) for g in range(4)], "b")} FROM (SELECT *, letters[k] AS letter FROM steps WHERE k > 0)))),
    best AS (SELECT conv_id, v0.c AS cost, v0.a AS audit FROM steps WHERE k = 0),
    edits AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(length(audit))) AS spot FROM best WHERE audit != ''),
    counted AS (
      SELECT *, count(*) FILTER (edit != 'I') OVER w AS pos, count(*) FILTER (edit != 'D') OVER w AS place FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY spot)),
    applied AS (
      SELECT c.conv_id, c.place, c.edit, CASE WHEN c.edit = 'I' THEN NULL ELSE l.role END AS role, CASE WHEN c.edit = 'I' THEN '' ELSE l.text END AS text
      FROM counted c LEFT JOIN lettered l ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.pos = l.pos WHERE c.edit != 'D'),
    systems AS (SELECT *, max(CASE WHEN place = 1 AND edit = 'K' AND role[1:1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM applied),
    repaired AS (
      SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS said
      FROM systems GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN convs c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id
    LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id"""


@query("op13_conversation_repair", _op13_sql())
def op13(spark, folder):
    from tracewell.llm.conversations import repair_plan, repaired_digests, repaired_rows

    rows = read(spark, folder, "conversations")
    damaged = _damaged_turns(rows)
    plan = repair_plan(damaged)
    texts = repaired_digests(repaired_rows(damaged, plan))
    every = rows.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    out = every.alias("o").join(plan.alias("p"), same("o", "p"), "left").join(texts.alias("t"), same("o", "t"), "left")
    # a conversation that lost all its rows has no plan, one that lost all its turns no text
    number = lambda c: F.when(F.col("signature").isNull(), F.lit(0).cast("bigint")).otherwise(F.col(c)).alias(c)
    return out.select(
        "o.conv_id", *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


@query("op10_html_extraction")
def op10(spark, folder):
    from tracewell.llm.extract import extract_text

    out = extract_text(read(spark, folder, "pages").select("page_id", "url", "html"))
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))
