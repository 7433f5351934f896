"""Learners by the names used in the parameter grids."""

from .bayes import fit_gaussian_nb, fit_lda
from .gradient import fit_mlp_classifier, fit_mlp_regressor, fit_sgd_classifier, fit_svr
from .kernel import CalibratedMargins, PipelinePair, fit_gp, fit_svm
from .knn import KnnModel, fit_knn, knn_fold_scores
from .linear import fit_elasticnet, fit_lasso, fit_logreg, fit_ols, fit_ridge
from .shared import lda_many, least_squares_many, nb_many
from .trees import (
    BaggedTrees,
    BoostedVote,
    OneVsRestModel,
    WeightedMedianTrees,
    fit_adaboost_classifier,
    fit_adaboost_regressor,
    fit_bagging_regressor,
    fit_forest_classifier,
    fit_forest_regressor,
    fit_gbt_classifier,
    fit_gbt_regressor,
    fit_tree_classifier,
    fit_tree_regressor,
)

CLASSIFIERS = {
    "LogR": fit_logreg, "LR-SGD": fit_sgd_classifier, "LDA": fit_lda, "DT": fit_tree_classifier,
    "RF": fit_forest_classifier, "AdaB": fit_adaboost_classifier, "XGB": fit_gbt_classifier, "SVM": fit_svm,
    "KNN": fit_knn, "NB": fit_gaussian_nb, "MLP": fit_mlp_classifier,
}
REGRESSORS = {
    "LR": fit_ols, "Ridge": fit_ridge, "Lasso": fit_lasso, "ElasticNet": fit_elasticnet, "DT": fit_tree_regressor,
    "RF": fit_forest_regressor, "AdaB": fit_adaboost_regressor, "XGB": fit_gbt_regressor,
    "Bagging": fit_bagging_regressor, "SVR": fit_svr, "GPR": fit_gp, "MLP": fit_mlp_regressor,
}

COMPOSITES = {c.__name__: c for c in (OneVsRestModel, BaggedTrees, BoostedVote, WeightedMedianTrees, PipelinePair, CalibratedMargins, KnnModel)}

# Learners whose candidates share one pass over the rows.
MANY = {
    fit_gaussian_nb: nb_many,
    fit_lda: lda_many,
    fit_ols: least_squares_many(lambda o: (lambda n: 0.0, 0.0)),
    fit_ridge: least_squares_many(lambda o: (lambda n: float(o.get("alpha", 1.0)) / n, 0.0)),
    fit_lasso: least_squares_many(lambda o: (lambda n: float(o.get("alpha", 1.0)), 1.0)),
    fit_elasticnet: least_squares_many(lambda o: (lambda n: float(o.get("alpha", 1.0)), float(o.get("l1_ratio", 0.5)))),
}

# Learners whose candidates are scored without a model each: (df, fold column, folds, candidates) -> accuracies.
SCORES = {fit_knn: knn_fold_scores}
