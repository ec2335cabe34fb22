from sparkfeat.plans.cards import (
    card_features, card_profile, float_columns, mix_features, monthly_profile, monthly_purchases,
    profile_spec, purchase_ratio, transaction_rows,
)
from sparkfeat.plans.machines import MACHINE_COLUMNS, machine_features
from sparkfeat.plans.numeric import row_features
from sparkfeat.plans.scoring import (
    PENALTY_SPACE, SEARCH_SPACE, OutOfFold, learner_params, oof_predictions, out_of_fold, random_search,
)
from sparkfeat.plans.selection import boruta_select, keep_confirmed

__all__ = [
    "MACHINE_COLUMNS", "PENALTY_SPACE", "SEARCH_SPACE", "OutOfFold", "boruta_select", "card_features", "card_profile",
    "float_columns", "keep_confirmed", "learner_params", "machine_features", "mix_features", "monthly_profile",
    "monthly_purchases", "oof_predictions", "out_of_fold", "profile_spec", "purchase_ratio", "random_search", "row_features",
    "transaction_rows",
]
