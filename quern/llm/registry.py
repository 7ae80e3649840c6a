"""The queries of this subpackage, and their SQL."""

from quern.llm import op1_urls as _op1
from quern.llm.op1_urls import op1_urls
from quern.llm.op2_licences import op2_licences
from quern.llm.op3_jaccard import op3_jaccard
from quern.llm.op4_lines import op4_lines
from quern.llm.op5_media import op5_media
from quern.llm.op6_quality import op6_quality
from quern.llm.op7_mixing import op7_mixing
from quern.llm.op8_brown import op8_brown
from quern.llm.op9_packing import op9_packing
from quern.llm.op10_rules import op10_rules


def queries():
    ops = (op1_urls, op2_licences, op3_jaccard, op4_lines, op5_media, op6_quality, op7_mixing, op8_brown, op9_packing, op10_rules)
    return {f.__name__: f for f in ops}


def oracle_sql():
    return {"op1_urls": _op1.SQL}
