"""Readers, writers and the policy that guards them."""
