"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from plumbline.llm import ball_kmeans, exact_stream, itq, lines, mixing, packing, passages, phrases, pieces, pii, quality, simhash, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality": quality.op2_quality,
    "op3_packing": packing.op3_packing,
    "op4_simhash": simhash.op4_simhash,
    "op5_itq": itq.op5_itq,
    "op6_pii": pii.op6_pii,
    "op7_passages": passages.op7_passages,
    "op8_exact": exact_stream.op8_exact,
    "op9_lines": lines.op9_lines,
    "op10_warc": warc.op10_warc,
    "op11_ball_kmeans": ball_kmeans.op11_ball_kmeans,
    "op12_phrases": phrases.op12_phrases,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}
ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op7_passages": passages.OP7_SQL,
    "op8_exact": exact_stream.OP8_SQL,
    "op9_lines": lines.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
    "op12_phrases": phrases.OP12_SQL,
}
