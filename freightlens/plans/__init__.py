from freightlens.plans.session import build_session, checkpoint_dir  # noqa: F401
