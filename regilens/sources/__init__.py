"""Table sources: staging schemas, file readers and the test-fixture adapter."""

from regilens.sources.fixtures import load_stages
from regilens.sources.schemas import DOG_STAGE, REGISTRATION_STAGE, STAGE_SCHEMAS, TRANSACTION_STAGE
from regilens.sources.staging import read_stage, read_stages

__all__ = [
    "load_stages", "read_stage", "read_stages", "DOG_STAGE", "REGISTRATION_STAGE",
    "TRANSACTION_STAGE", "STAGE_SCHEMAS",
]
