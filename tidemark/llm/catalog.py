"""The queries of this package and their SQL."""

import corpus_pipeline
from tidemark.llm.byte_repeats import op2_suffix_dedup
from tidemark.llm.collocations import OP11_SQL, op11_collocations
from tidemark.llm.decontaminate import op4_decontaminate
from tidemark.llm.embeddings import op1_embedding_dedup
from tidemark.llm.lexicon import op12_bpe_transducer
from tidemark.llm.lines import op7_line_dedup
from tidemark.llm.middle import OP13_SQL, op13_fill_in_middle
from tidemark.llm.minhash import op5_minhash_dedup
from tidemark.llm.mixing import op9_source_mixing
from tidemark.llm.oracles import OP1_SQL, OP2_SQL, OP5_SQL, OP8_SQL
from tidemark.llm.quality import op10_quality_resample
from tidemark.llm.templates import OP6_SQL, op6_chat_format
from tidemark.llm.warc import OP3_SQL, op3_warc_index
from tidemark.llm.word_repeats import op8_substring_dedup

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_warc_index": op3_warc_index,
    "op4_decontaminate": op4_decontaminate,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_line_dedup": op7_line_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_source_mixing": op9_source_mixing,
    "op10_quality_resample": op10_quality_resample,
    "op11_collocations": op11_collocations,
    "op12_bpe_transducer": op12_bpe_transducer,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op1_embedding_dedup": OP1_SQL,
    "op2_suffix_dedup": OP2_SQL,
    "op3_warc_index": OP3_SQL,
    "op5_minhash_dedup": OP5_SQL,
    "op6_chat_format": OP6_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op11_collocations": OP11_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
