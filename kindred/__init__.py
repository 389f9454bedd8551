"""Compare representations, and score them against measured responses, on Spark."""

from kindred.operators.evidence import log_posterior, loglik, marginal, winner_counts
from kindred.operators.gram import add_noise, condition, gram_from_features, trace_norm
from kindred.operators.gram_compare import compare_gram, symmetrize
from kindred.operators.layer_compare import compare_layers
from kindred.operators.reliability import beta_noise_grid, cell_stats, fitted_noise_grid, noise_estimation, voxel_reliability
from kindred.plans.registry import register_measure
from kindred.session import ship_package
from kindred.sources.activations import Layers, extract, slices
from kindred.sources.tables import compare_to_table, gram_job

__all__ = [
    "Layers",
    "add_noise",
    "beta_noise_grid",
    "cell_stats",
    "compare_gram",
    "compare_layers",
    "compare_to_table",
    "condition",
    "extract",
    "gram_from_features",
    "gram_job",
    "log_posterior",
    "loglik",
    "marginal",
    "noise_estimation",
    "fitted_noise_grid",
    "register_measure",
    "ship_package",
    "slices",
    "symmetrize",
    "trace_norm",
    "voxel_reliability",
    "winner_counts",
]
