"""The queries of this subpackage and the SQL of those that SQL can express."""

from strandlake.llm.digest import op9_fingerprints
from strandlake.llm.divergence import OP11_SQL, op11_divergence
from strandlake.llm.exact import OP13_SQL, op13_exact
from strandlake.llm.lines import op7_lines
from strandlake.llm.mixing import OP2_SQL, op2_mixing
from strandlake.llm.neighbours import op1_neighbours
from strandlake.llm.packing import op3_packing
from strandlake.llm.periodic import op12_periodic
from strandlake.llm.pii import op5_pii
from strandlake.llm.secrets import op4_secrets
from strandlake.llm.simhash import op10_simhash
from strandlake.llm.toxicity import op8_toxicity
from strandlake.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_mixing": op2_mixing,
    "op3_packing": op3_packing,
    "op4_secrets": op4_secrets,
    "op5_pii": op5_pii,
    "op6_warc": op6_warc,
    "op7_lines": op7_lines,
    "op8_toxicity": op8_toxicity,
    "op9_fingerprints": op9_fingerprints,
    "op10_simhash": op10_simhash,
    "op11_divergence": op11_divergence,
    "op12_periodic": op12_periodic,
    "op13_exact": op13_exact,
}

ORACLES = {"op2_mixing": OP2_SQL, "op6_warc": OP6_SQL, "op11_divergence": OP11_SQL, "op13_exact": OP13_SQL}
