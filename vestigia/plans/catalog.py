"""All registered queries. Importing a plan module registers its queries."""

from vestigia.plans import case_plans  # noqa: F401
from vestigia.plans import compare_plans  # noqa: F401
from vestigia.plans import graph_plans  # noqa: F401
from vestigia.plans import matching_plans  # noqa: F401
from vestigia.plans import measure_plans  # noqa: F401
from vestigia.plans import network_plans  # noqa: F401
from vestigia.plans import predicate_plans  # noqa: F401
from vestigia.plans import rollup_plans  # noqa: F401
from vestigia.plans import sequence_plans  # noqa: F401
from vestigia.plans import similarity_plans  # noqa: F401
from vestigia.plans import source_plans  # noqa: F401
from vestigia.plans import stream_plans  # noqa: F401
from vestigia.plans import structure_plans  # noqa: F401
from vestigia.plans import text_plans  # noqa: F401
from vestigia.plans import time_plans  # noqa: F401
from vestigia.plans.registry import ORACLES, QUERIES  # noqa: F401
