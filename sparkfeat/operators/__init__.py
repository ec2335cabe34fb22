from sparkfeat.operators.augment import augment, shuffle_columns, with_shadows
from sparkfeat.operators.encode import (
    bucket_rare, bucket_rare_apply, bucket_rare_fit, factorize, factorize_fit, target_encode,
    target_encode_apply, target_encode_columns, target_encode_fit,
)
from sparkfeat.operators.evaluate import auc_metric, exact_auc, metric_row, neg_rmse, neg_rmse_metric
from sparkfeat.operators.folds import hashed_folds, stratified_folds
from sparkfeat.operators.group_means import mean_encode, with_group_mean
from sparkfeat.operators.impute import fill_mean, fill_quantile
from sparkfeat.operators.lag import lag_difference, lag_ratio, with_previous
from sparkfeat.operators.lookups import left_join_all, lookup
from sparkfeat.operators.narrow import narrow_types, narrowing_report
from sparkfeat.operators.profile import (
    by_whole_keys, distinct_profile, entity_profile, smoothed_group_mean, successive_aggregate,
    successive_features, two_level_profile, value_counts,
)
from sparkfeat.operators.project import (
    cast_columns, drop_columns, feature_columns, map_values, month_diff, normalise_nan, one_hot,
    patch_value, replace_values, select_features, select_supported, split_all_null, time_features,
)
from sparkfeat.operators.quantiles import (
    exact_quantiles, merge_quantile_states, quantile_state, state_quantiles, with_global_quantiles,
)
from sparkfeat.operators.ranking import running_total
from sparkfeat.operators.ratios import ratio_features, recency_features
from sparkfeat.operators.rowstats import row_statistics
from sparkfeat.operators.version import segment_widths, version_number
