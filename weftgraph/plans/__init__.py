"""weftgraph.plans"""
