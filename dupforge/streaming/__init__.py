"""Catalogues that grow: exact copies among records that keep arriving."""
