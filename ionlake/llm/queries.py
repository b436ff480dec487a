"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, fim, htmltext, idfiles, langid, ordermin, packing, pii, secrets, simhash, tokencount, warc
from .common import shared_folder, table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: In production the key of surrogates comes from outside; a fixed one makes the query's result repeatable.
SURROGATE_KEY = "surrogates-1"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.sort_array(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), "contaminated")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    count = {f"n_{kind}": of(kind) for kind in secrets.KINDS}
    return found.select("doc_id", *(c.alias(n) for n, c in count.items()), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), PIECES)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY, counts="n_entities")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.edited(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op11_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/ids-{uuid.uuid4()}"
    idfiles.write(table(spark, sf_dir, "documents"), folder, WORD_TOKENIZER)
    return idfiles.read(spark, folder, "binary").select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.transform(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored()).alias("restored_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_secrets": op3_secrets,
    "op4_token_counts": op4_token_counts,
    "op5_language": op5_language,
    "op6_simhash": op6_simhash,
    "op7_warc": op7_warc,
    "op8_pii": op8_pii,
    "op9_order_minhash": op9_order_minhash,
    "op10_html_text": op10_html_text,
    "op11_id_files": op11_id_files,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_alignment": op13_alignment,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: DuckDB SQL for the queries that it can express.
SQL: dict[str, str] = {
    "op2_decontamination": f"""with item as (select item_id, {_WORDS} as ws from benchmark),
win as (select item_id, unnest(case when len(ws) = 0 then [] when len(ws) < 10 then [ws] else list_transform(range(len(ws) - 9), lambda i: ws[i + 1 : i + 10]) end) as w from item),
phrase as (select distinct w, len(w) as n from win), sizes as (select distinct n from phrase),
doc as (select doc_id, {_WORDS} as ws from documents), place as (select doc_id, ws, unnest(range(len(ws))) as i from doc),
here as (select doc_id, i, n, ws[i + 1 : i + n] as w from place, sizes where i + n <= len(ws)),
occ as (select doc_id, i, here.n, w from here join phrase using (w)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from occ) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, item_id::varchar as item from occ join win using (w)) group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit using (doc_id) left join found using (doc_id)""",
    "op12_fill_in_middle": r"""with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
k as (select *, len(u) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from k),
t as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:n], '') as s from f)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from t""",
    "op7_warc": """with p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as h, octet_length(encode(coalesce(html, '')))::bigint as n from pages),
o as (select h, max(page_id) as best, count(*) as copies from p where n >= 1000 group by h)
select page_id, n as payload_bytes, sha1(p.h) as payload_digest, case when copies > 1 and page_id <> best then 'revisit' else 'response' end as record_type, case when copies > 1 and page_id <> best then best end as refers_to, url from p left join o on p.h = o.h""",
}
