"""What a database refuses to do."""


class VectorDBError(Exception):
    """Base of all."""


class NoVectors(VectorDBError):
    pass


class NotBuilt(VectorDBError):
    pass


class NotFound(VectorDBError):
    pass


class EmptyId(VectorDBError):
    pass


class WrongDimension(VectorDBError):
    pass


class InvalidConfig(VectorDBError):
    pass


class AlreadyExists(VectorDBError):
    pass


class RepeatedId(VectorDBError):
    pass
