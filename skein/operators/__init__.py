"""DataFrame operators: relational ones of the code index and the general data-preparation ones."""
