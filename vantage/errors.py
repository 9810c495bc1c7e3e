"""Errors of the library. Each carries its parts as attributes, and reads as one sentence."""

from __future__ import annotations


class VantageError(Exception):
    """Base of all errors; `variant` says which, `parts` holds its values."""

    def __init__(self, variant: str, message: str, **parts):
        super().__init__(message)
        self.variant = variant
        self.parts = parts

    def __getattr__(self, name: str):
        try:
            return self.__dict__["parts"][name]
        except KeyError:
            raise AttributeError(name) from None

    def __reduce__(self):
        return _rebuilt, (type(self), self.variant, str(self), self.parts)


def _rebuilt(kind, variant, message, parts):
    return kind(variant, message, **parts)


class DataError(VantageError):
    """EmptyFeatureName, EmptyFeature, NoFeatures, UnsupportedFeature, NoOutcomes, RowCountMismatch, DuplicateFeatureName,
    NonFiniteValue, EmptyCategoryValue, InvalidCategoryCode, TooManyCategories, NullCase."""


class PrimError(VantageError):
    """InvalidParameter."""


class CandidateSelectionError(VantageError):
    """InvalidMinimumDensity."""


class RestrictionEffectError(VantageError):
    """PositionOutOfRange, DatasetMismatch."""


class CaseConditionError(VantageError):
    """InapplicableRule, NoConditions, AbsentValue."""


class OutputPathError(VantageError):
    """UnknownOutput, UnknownField, UnknownVariant, UnknownKey, FieldOfUnion, NotSelectable."""


class EvaluationDatasetError(VantageError):
    """OutputSlotOutOfBounds, InapplicableRule, FailedRow, ForeignPath, Condition, InvalidDataset."""


class EvaluationTableError(VantageError):
    """MismatchedId, InvalidInputs, RowCountMismatch, InvalidOutputRow, DuplicateId."""


class EvaluationDecodeError(VantageError):
    """Record, Schema, LayoutMetadata, FormatVersion, BatchSchema, ColumnType, RowOrder, SeedMismatch, Inputs, Outputs,
    UnknownOutcome, MissingOutcomePart, OutcomeValues, Subject, CountOverflow, Table."""


class EvaluationWriteError(VantageError):
    """Session, Arrow."""


class EvaluationReadError(VantageError):
    """Arrow, Decode."""


class SamplingError(VantageError):
    """NoRows, RowCountOverflow, TooManyContinuousStrata, FeaturePositionOverflow, UnboundedInput, UnsampleableDomain,
    UnsupportedInput, InvalidBatch."""


class ModelSchemaError(VantageError):
    """Label, NonFiniteBound, InvalidBounds, InvalidKey, Interface, Session."""


class RequestSplitError(VantageError):
    """SequenceOverflow."""


class EvaluatorPoolError(VantageError):
    """NoEvaluators, SchemaMismatch."""


class PoolEvaluationError(VantageError):
    """Evaluator, Panic, MissingResult, NotEvaluated."""


class InputAccessError(VantageError):
    """RowIndexOutOfBounds, UnknownSlot, KindMismatch."""


class OutputRowError(VantageError):
    """CountMismatch, KindMismatch."""


class ChunkResultError(VantageError):
    """NoRows."""


class ChunkingPolicyError(VantageError):
    """ZeroRowsPerChunk."""


class ExportError(VantageError):
    """InvalidFile, StepOutOfRange, MembershipMismatch, DimensionMismatch."""
