"""What a store refuses, with the exit codes of the command line."""


class StoreError(Exception):
    code = 1


class NotFound(StoreError):
    code = 2


class Corruption(StoreError):
    code = 3


class InvalidArgument(StoreError):
    code = 4


class InvariantViolation(StoreError):
    code = 5


class LockConflict(StoreError):
    code = 6


class TxnConflict(StoreError):
    code = 7


class ClockSkew(StoreError):
    code = 8
