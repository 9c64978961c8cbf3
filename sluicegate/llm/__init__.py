"""Operations of a training-data pipeline; nothing else in the library imports them."""

from sluicegate.llm import (
    burst_trie,
    chunk_bpe,
    exact_dedup,
    lang_id,
    mixing,
    ngram_lm,
    packing,
    permutation_index,
    pii_feistel,
    secret_scan,
    suffix_dedup,
    superminhash,
    whitening,
)

QUERIES: dict = {}
SQL: dict = {}
for _module in (pii_feistel, ngram_lm, suffix_dedup, permutation_index, chunk_bpe, superminhash, secret_scan,
                exact_dedup, mixing, lang_id, whitening, packing, burst_trie):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
