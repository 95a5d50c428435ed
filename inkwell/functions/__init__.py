"""Column expressions shared by the jobs. All are built-in Spark functions,
so they stay inside whole-stage codegen; no Python runs per row."""

from inkwell.functions.numeric import (  # noqa: F401
    decade, js_round, percent, percent_round, round6, safe_div, strict_sum,
)
from inkwell.functions.text import (  # noqa: F401
    capitalize_first, clean_name, recode, title_strip_year, title_year, trim_all,
)
from inkwell.functions.bins import choropleth_bin, legend_class  # noqa: F401
