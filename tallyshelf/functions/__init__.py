from .calendar import month_index, month_label, week_of_year
from .labels import label_ladder
from .numbers import mean_of, moment_names, moment_sums, moments, pop_sd, quotient, rnd

__all__ = [
    "label_ladder", "mean_of", "moment_names", "moment_sums", "moments", "month_index", "month_label",
    "pop_sd", "quotient", "rnd", "week_of_year",
]
