"""Registered queries of the pipeline operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers

from . import divergence, impact, langid, licenses, mih, mixing, packing, pii, repair, simhash, tokens, urls, warc
from .common import table

#: The tokenizer file is a parameter of the operators; these queries use the public one.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_impact_topk(spark, sf_dir):
    return impact.top_k(table(spark, sf_dir, "embeddings"))


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_urls(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).drop("bound")


def op5_warc(spark, sf_dir):
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_langid(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_mih(spark, sf_dir):
    return mih.nearest(table(spark, sf_dir, "embeddings"))


def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_repair(spark, sf_dir):
    return repair.audited(repair.damaged(table(spark, sf_dir, "conversations")))


def op12_pii(spark, sf_dir):
    return pii.digests(pii.scan(table(spark, sf_dir, "documents")))


def op13_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable]:
    return {f.__name__: f for f in (op1_impact_topk, op2_simhash, op3_licenses, op4_urls, op5_warc, op6_langid, op7_mih, op8_mixing, op9_packing, op10_token_counts, op11_repair, op12_pii, op13_divergence)}


def oracle_sql() -> dict[str, str]:
    """The two native operators, and the exact search; hashes, models and tokenizers are tested against brute force instead."""
    return {"op1_impact_topk": impact.oracle(), "op3_licenses": licenses.oracle(), "op4_urls": urls.oracle(), "op5_warc": warc.oracle(), "op12_pii": pii.oracle(), "op13_divergence": divergence.oracle()}
