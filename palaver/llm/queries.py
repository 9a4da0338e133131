"""The queries of this subpackage, and SQL for those that SQL can express."""

from . import conversation_trie, decontamination, hamming_search, hard_negatives, url_filters, warc_archive
from .byte_bpe_codec import op11_byte_bpe_codec
from .conversation_trie import op12_conversation_trie
from .decontamination import decontamination_proximity, op10_decontamination
from .hamming_search import op5_hamming_search
from .hard_negatives import op13_hard_negatives
from .language_id import op3_language_id
from .quality_classifier import op4_quality_classifier
from .sentencepiece_codec import op6_sentencepiece_codec
from .sharding import op2_sharding
from .simhash_dedup import op7_simhash_dedup
from .token_counts import op1_token_counts
from .url_filters import op9_url_filters
from .warc_archive import op8_warc_archive

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_sharding, op3_language_id, op4_quality_classifier, op5_hamming_search, op6_sentencepiece_codec, op7_simhash_dedup, op8_warc_archive, op9_url_filters, op10_decontamination, op11_byte_bpe_codec, op12_conversation_trie, op13_hard_negatives, decontamination_proximity)}

ORACLE_SQL = {
    "op5_hamming_search": hamming_search.OP5_SQL,
    "op8_warc_archive": warc_archive.OP8_SQL,
    "op9_url_filters": url_filters.OP9_SQL,
    "op10_decontamination": decontamination.OP10_SQL,
    "op12_conversation_trie": conversation_trie.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
