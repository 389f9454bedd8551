"""Names, aliases and properties of the comparison measures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from kindred.functions import pair_measures as pm
from kindred.functions.scalars import simplify_name


@dataclass(frozen=True)
class Measure:
    name: str
    similarity: bool
    #: "sampled" and "gaussian" need positive definite matrices
    family: str
    centred: bool = False
    #: of a measure added by :func:`register_measure`
    function: Callable[[pm.Conditioned, "Params"], float] | None = None

    @property
    def diagonal(self) -> float:
        return 1.0 if self.similarity else 0.0


MEASURES: dict[str, Measure] = {
    m.name: m
    for m in (
        Measure("wasserstein", False, "spectral"),
        Measure("hellinger", False, "gaussian"),
        Measure("mahalanobis", False, "spectral"),
        Measure("jsd", False, "sampled"),
        Measure("tvd", False, "sampled"),
        Measure("bhattacharyya", False, "gaussian"),
        Measure("kldiv", False, "gaussian"),
        Measure("cka", True, "entrywise", centred=True),
        Measure("rsacorr", True, "entrywise"),
        Measure("rsarank", True, "rank"),
        Measure("rsacos", True, "entrywise"),
        Measure("rsaarccos", True, "entrywise"),
        Measure("gulp", False, "spectral"),
        Measure("distcorr", True, "entrywise", centred=True),
        Measure("jaccard", True, "neighbour"),
        Measure("procrustes", False, "spectral", centred=True),
        Measure("nbs", True, "spectral", centred=True),
    )
}

# The accepted spellings, after simplification, besides the names above.
ALIASES: dict[str, str] = {
    "totalvariation": "tvd",
    "totalvariationdistance": "tvd",
    "jensenshannon": "jsd",
    "jensenshannondivergence": "jsd",
    "jensenshannondistance": "jsd",
    "kldivergence": "kldiv",
    "kernelgulp": "gulp",
    "distancecorrelation": "distcorr",
    "normalizedburessimilarity": "nbs",
    "normburessim": "nbs",
}


def register_measure(
    name: str,
    function: Callable[[pm.Conditioned, "Params"], float],
    similarity: bool = False,
    centred: bool = False,
    aliases: tuple[str, ...] = (),
) -> Measure:
    """Add a measure of one's own, to be named like the others in every comparison.

    ``function`` gets a conditioned (and, if ``centred``, centred) pair of matrices and the parameters of the
    comparison, and returns a number; it travels to the tasks with the comparison. A ``LinAlgError`` counts
    as "undefined". Names of existing measures are refused.
    """
    keys = [simplify_name(n) for n in (name, *aliases)]
    taken = [k for k in keys if k in MEASURES or k in ALIASES]
    if taken:
        raise ValueError(f"already a measure: {taken}")
    measure = Measure(keys[0], similarity, "spectral", centred, function)
    MEASURES[keys[0]] = measure
    ALIASES.update(dict.fromkeys(keys[1:], keys[0]))
    return measure


def forget_measure(measure: Measure) -> None:
    """Remove a registered measure and its aliases; comparisons that were built with it still work."""
    if measure.function is None:
        raise ValueError(f"{measure.name} is built in")
    MEASURES.pop(measure.name, None)
    for alias in [a for a, name in ALIASES.items() if name == measure.name]:
        del ALIASES[alias]


def resolve(name: str) -> Measure:
    """Look a measure up by any spelling of its name."""
    key = simplify_name(name)
    key = ALIASES.get(key, key)
    if key not in MEASURES:
        raise NotImplementedError(f"unknown measure {name!r}; known: {sorted(MEASURES)}")
    return MEASURES[key]


def resolve_all(names: str | list[str] | tuple[str, ...]) -> list[Measure]:
    return [resolve(n) for n in ([names] if isinstance(names, str) else names)]


@dataclass(frozen=True)
class Params:
    """Everything a comparison depends on besides its input."""

    noise_var: float | None = None
    b: float = 0.01
    normalize: bool = True
    lmbd: float | None = None
    k: int | None = None
    #: draws of each distribution from which total variation and Jensen-Shannon are estimated; None computes them
    samples: int | None = None
    seed: int = 0
    root_mean_term: bool = False
    #: draw samples from digests, slowly but the same in any engine
    portable: bool = False
    #: the square root of the Jensen-Shannon divergence, a metric
    jsd_sqrt: bool = False
    #: Bures similarity divided by n, so that equal matrices give 1
    nbs_unit: bool = False

    def check(self, measures: list[Measure]) -> None:
        names = {m.name for m in measures}
        if "gulp" in names and self.lmbd is None:
            raise ValueError("gulp needs lmbd")
        if "jaccard" in names and not self.k:
            raise ValueError("jaccard needs k")


def per_measure(measures, b=0.01, noise_var=None, normalize=True) -> list[tuple[Measure, dict]]:
    """Pair every measure with its conditioning; scalars apply to all measures."""
    resolved = resolve_all(measures)

    def spread(label, value, kinds):
        values = list(value) if isinstance(value, (list, tuple)) else [value] * len(resolved)
        if len(values) != len(resolved):
            raise ValueError(f"{label}: {len(values)} values for {len(resolved)} measures")
        for v in values:
            if isinstance(v, bool) != (kinds is bool) or not isinstance(v, kinds):
                raise TypeError(f"{label} cannot be {type(v).__name__}")
        return values

    bs = spread("b", b, (int, float))
    nus = spread("noise_var", noise_var, (int, float, type(None)))
    norms = spread("normalize", normalize, bool)
    return [
        (m, {"b": float(x), "noise_var": None if y is None else float(y), "normalize": z})
        for m, x, y, z in zip(resolved, bs, nus, norms)
    ]


def evaluate(measure: Measure, pair: pm.Conditioned, params: Params, rng) -> float:
    """Value of a matrix measure on a conditioned (and, if required, centred) pair."""
    if measure.function is not None:
        return float(measure.function(pair, params))
    match measure.name:
        case "wasserstein":
            return pm.wasserstein(pair)
        case "hellinger":
            return pm.hellinger(pair, params.root_mean_term)
        case "mahalanobis":
            return pm.mahalanobis(pair)
        case "bhattacharyya":
            return pm.bhattacharyya(pair, params.root_mean_term)
        case "kldiv":
            return pm.kl_divergence(pair)
        case "tvd":
            return pm.total_variation(pair, params.samples, rng)
        case "jsd":
            value = pm.jensen_shannon(pair, params.samples, rng)
            return value**0.5 if params.jsd_sqrt else value
        case "gulp":
            return pm.gulp(pair, params.lmbd)
        case "cka":
            return pm.centred_alignment(pair)
        case "distcorr":
            return float(max(pm.centred_alignment(pair), 0.0) ** 0.5)
        case "rsacorr" | "rsacos" | "rsaarccos":
            return pm.distance_similarity(pair, measure.name)
        case "rsarank":
            return pm.rank_similarity(pair)
        case "jaccard":
            return pm.neighbour_overlap(pair, params.k)
        case "procrustes":
            return pm.procrustes(pair)
        case "nbs":
            return pm.bures_similarity(pair) / (pair.n if params.nbs_unit else 1)
    raise NotImplementedError(measure.name)
