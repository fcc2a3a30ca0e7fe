"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from docmeter.llm.decontaminate import OP9_SQL, op9_decontaminate
from docmeter.llm.language import op10_language
from docmeter.llm.license_scan import OP2_SQL, op2_license_scan
from docmeter.llm.mixing import op6_mix
from docmeter.llm.ngrams import op13_perplexity
from docmeter.llm.ogg import op4_ogg_media
from docmeter.llm.quality import op7_quality
from docmeter.llm.ranked import OP11_SQL, op11_ranked
from docmeter.llm.simhash import op5_simhash
from docmeter.llm.spelling import op12_spelling
from docmeter.llm.suffix_dedup import op8_suffix_dedup
from docmeter.llm.toxicity import op3_toxicity
from docmeter.llm.warc import OP1_SQL, op1_warc

QUERIES = {f.__name__: f for f in (op1_warc, op2_license_scan, op3_toxicity, op4_ogg_media, op5_simhash, op6_mix, op7_quality, op8_suffix_dedup, op9_decontaminate, op10_language, op11_ranked, op12_spelling, op13_perplexity)}

ORACLES: dict[str, str] = {"op1_warc": OP1_SQL, "op2_license_scan": OP2_SQL, "op9_decontaminate": OP9_SQL, "op11_ranked": OP11_SQL}
