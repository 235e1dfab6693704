from basketry.functions.exprs import (cut, lookup, climate_group, concat_text, yes_flag,
                                      target_code, safe_div, round_half_even)

__all__ = ["cut", "lookup", "climate_group", "concat_text", "yes_flag", "target_code",
           "safe_div", "round_half_even"]
