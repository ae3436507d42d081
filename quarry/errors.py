"""Request errors.  Messages are the contract with clients."""


class LogicError(Exception):
    """A request that is well-formed JSON but breaks a rule."""


class UnknownName(LogicError, KeyError, ValueError):
    """An entity or an enum member that doesn't exist."""

    def __str__(self) -> str:
        return self.args[0]


#: Messages by code.
SETS_UNIQUE_SORT = "ListOfConditionsSetsMustHasUniqueSortValue"
CONDITIONS_UNIQUE_SORT = "AnyListOfConditionsMustHasUniqueSortValue"
SUB_GROUPS_UNIQUE_SORT = "AnyListOfSubConditionsGroupsMustHasUniqueSortValue"
REQUIRED_INTERSECTION = "ConditionsSetOfIndex[1-N]MustHasIntersection"
INVALID_FIELD = "ConditionMustHasValidFieldName"
INVALID_VALUE = "ConditionValuesAreNullOrWhiteSpace"
REQUIRED_VALUES = "ConditionWithOperator[In-IIn-NotIn-INotIn]MustHasOneOrMoreValues"
NOT_REQUIRED_VALUES = "ConditionWithOperator[IsNull-IsNotNull]MustHasNoValues"
REQUIRED_TWO_VALUE = "ConditionWithOperator[Between-NotBetween]MustHasOnlyTwoValues"
INVALID_PAGE_NUMBER = "PageNumberMustBeGreaterThanZero"
INVALID_PAGE_SIZE = "PageSizeMustBeGreaterThanZero"
MUST_HAVE_FIELDS = "MustHasFields"
INVALID_FORMAT = "InvalidFormat"
INVALID_ALIAS = "AggregationMustHasValidAlias"
AGGREGATION_FIELD_SIMPLE = "AggregationFieldMustBeSimpleType"
AGGREGATION_FIELD_COLLECTION = "AggregationFieldCannotBeCollectionType"
GROUP_BY_FIELDS = "GroupByMustHasAtLeastOneField"
GROUP_BY_UNIQUE = "GroupByFieldsMustBeUnique"
GROUP_BY_COMPLEX = "GroupByFieldCannotBeComplexType"
GROUP_BY_COLLECTION = "GroupByFieldCannotBeCollectionType"
ALIASES_UNIQUE = "AggregationAliasesMustBeUnique"


def required_one_value(operator: str) -> str:
    return f"ConditionWithOperator[{operator}]MustHasOnlyOneValue"


def unsupported_aggregator(aggregator: str, field_type: str) -> str:
    return f"Aggregator[{aggregator}]IsNotSupportedForFieldType[{field_type}]"


def alias_is_group_field(alias: str) -> str:
    return f"AggregationAlias[{alias}]CannotBeUsedInGroupByFields"


def summary_order_field(field: str) -> str:
    return f"SummaryOrderField[{field}]MustExistInGroupByFieldsOrAggregateByAliases"


def order_ends_on_collection(field: str) -> str:
    return f"OrderField[{field}]CannotEndOnCollectionOfComplexElements"


def having_field(field: str) -> str:
    return f"HavingField[{field}]MustExistInAggregateByAliases"
