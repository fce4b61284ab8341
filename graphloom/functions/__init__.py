"""Scalar ``Column`` builders."""
