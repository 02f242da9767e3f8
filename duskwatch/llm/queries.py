"""The registered queries of the text operators: production parameters, whole tables, the columns their contracts name."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.llm import arrowids, chat, decontaminate, divergence, licences, packing, periodic, qda, rules, sharding, simhash, toxicity, warc
from duskwatch.llm.common import table, write_once


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive(table(spark, folder, "pages"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.bucketed(packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return toxicity.scores(documents, toxicity.fit(documents, table(spark, folder, "labels")))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return rules.verdicts(documents, rules.fit(documents, table(spark, folder, "labels")))


def op5_arrow_ids(spark: SparkSession, folder: str) -> DataFrame:
    found = arrowids.documents_in_files(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.classes(table(spark, folder, "documents"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contained(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_licences(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return licences.scan(documents, licences.fit(documents))


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return qda.scores(documents, qda.fit(documents, table(spark, folder, "labels")))


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    conversations = chat.with_probe(table(spark, folder, "conversations"), spark)
    formatted = chat.windows(conversations, public_tokenizers.path("byte_bpe_50k.json"))
    return chat.digests(write_once(formatted, "windows"))


def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows, key, size = sharding.keyed(table(spark, folder, "documents").select("doc_id", "text"))
    placed = sharding.assign(rows.select("doc_id", size, F.crc32(text.cast("binary")).alias("text_crc32"), key), key, size)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of op13's contract: in a tenth of the documents a stretch repeats from some word on."""
    code = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if code % 10 or not words:
        return words
    code //= 10
    first = code % len(words)
    period = 1 + (len(words) - first) // (3 + code % 8)
    once = words[first : first + period]
    return words[:first] + (once * (-(-(len(words) - first) // period)))[: len(words) - first]


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, folder, "documents"), rewrite=planted)
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_arrow_ids": op5_arrow_ids,
    "op6_simhash": op6_simhash,
    "op7_decontamination": op7_decontamination,
    "op8_licences": op8_licences,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_chat": op10_chat,
    "op11_divergence": op11_divergence,
    "op12_sharding": op12_sharding,
    "op13_periodic_runs": op13_periodic_runs,
}

_WORDS = "list_filter(string_split(regexp_replace(lower(text), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g'), ' '), lambda w: w <> '')"
_RUNS = "unnest(list_distinct(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))))"
ORACLES = {
    "op1_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
        f as (select *, min(page_id) over (partition by payload_digest) as least from p)
        select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> least then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= 100 and page_id <> least then least end as refers_to
        from f""",
    "op7_decontamination": f"""
        with d as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
        b as (select item_id, row_number() over () as q, least(len(w), 5) as n, w from (select item_id, {_WORDS} as w from benchmark)),
        ds as (select doc_id, r, {_RUNS} as s from d, (select distinct n from b where n > 0) where len(w) >= n),
        bs as (select item_id, q, {_RUNS} as s from b where n > 0),
        size as (select q, count(*) as n from bs group by q)
        select doc_id, item_id, count(*) as matched, any_value(n) as item_shingles, count(*) / any_value(n) as containment
        from ds join bs using (s) join size using (q) group by doc_id, r, item_id, q having count(*) >= 0.8 * any_value(n)""",
    "op11_divergence": """
        with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
        g as (select distinct lang, source from d),
        w as (select lang, source, r, unnest(w) as term from d),
        k as (select lang, term, count(*) as n from w group by lang, term having count(distinct r) >= 10),
        c as (select w.lang, w.source, w.term, count(*) as n from w join k on w.lang = k.lang and w.term = k.term group by w.lang, w.source, w.term),
        l as (select lang, count(*) as v, sum(n) as total from k group by lang),
        t as (select g.lang, g.source, coalesce((select sum(c.n) from c where c.lang = g.lang and c.source = g.source), 0) as total from g),
        q as (select k.lang, k.term, 1 + (1000000000::hugeint * (k.n + 2)) // (l.total + 2 * l.v)::hugeint as q from k join l on k.lang = l.lang),
        p as (select t.lang, t.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (t.total + 2 * l.v)::hugeint as p
            from t join k on t.lang = k.lang join l on t.lang = l.lang left join c on c.lang = t.lang and c.source = t.source and c.term = k.term),
        sums as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
            from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
        pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sums.value, 0)::bigint as value
            from g a join g b on a.lang = b.lang and a.source <> b.source
            left join sums on sums.lang = a.lang and sums.source = a.source and sums.item = b.source),
        single as (select p.lang, p.source, 'term' as part, p.term as item, (((p.p - q.q) * (p.p - q.q)) // (p.p + q.q))::bigint as value
            from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p.p > q.q),
        ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
            from (select * from pairs union all select * from single) u)
        select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10""",
}
