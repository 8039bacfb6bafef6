"""All operators and functions by their names, flat: ``from prepline import api as p; p.impute(df, ["x"])``."""

from prepline.functions.coupons import coverage_probability, subsamples_needed
from prepline.functions.namespaces import NumExt, StrExt, num_ext, str_ext
from prepline.functions.numeric import abs_diff, count_phrases, cv, frac, gcd, harmonic_mean, lcm, lempel_ziv_complexity, range_over_mean, rms, std_err
from prepline.functions.text import hamming_bits, hamming_chars, hamming_dist, levenshtein_dist, snowball_stem, str_jaccard
from prepline.operators.columns import *  # noqa: F403
from prepline.operators.diagnose import *  # noqa: F403
from prepline.operators.encode import *  # noqa: F403
from prepline.operators.fill import fill_missing, filled_cells, fit_fills
from prepline.operators.impute import *  # noqa: F403
from prepline.operators.infer import *  # noqa: F403
from prepline.operators.metrics import *  # noqa: F403
from prepline.operators.models import *  # noqa: F403
from prepline.operators.quality import Baseline, Limits, failed_checks, fit_baseline, profile_loads, value_counts
from prepline.operators.quantiles import column_modes, column_quantiles
from prepline.operators.reports import *  # noqa: F403
from prepline.operators.sample import *  # noqa: F403
from prepline.operators.scale import *  # noqa: F403
from prepline.operators.schema import *  # noqa: F403
from prepline.operators.select import *  # noqa: F403
from prepline.operators.strings import *  # noqa: F403
from prepline.plans import Pipeline, Step, StepsTransformer
from prepline.sources import DataCube, release, scan, write
from prepline.streaming import apply_to_stream

